"""DataFrame operators: repair, rules, duplicates, profiles, index, search."""
