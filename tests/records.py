"""Hand-made records for the tests."""

import json


def good(n=1, **changes):
    record = {
        "id": f"PRM-{n:06d}",
        "version": "1.0.0",
        "category": "ui_components",
        "subcategory": "nav_bars",
        "title": f"A navigation bar number {n}",
        "slug": f"nav-bar-{n}x",
        "language": "en",
        "difficulty": "beginner",
        "audience": "designer",
        "use_case": "component_generation",
        "industry": "saas",
        "style": {
            "visual_style": "plain look", "layout_style": "one column",
            "color_direction": "blue tones", "motion_style": "no motion",
        },
        "tech_stack": {
            "framework": "Vue", "language": "TypeScript", "styling": "CSS",
            "animation": "GSAP", "optional_libraries": ["x"],
        },
        "prompt": f"Entry {n} begins. " + " ".join(f"word{i}" for i in range(100)),
        "negative_prompt": "No clutter.",
        "acceptance_criteria": ["It renders well", "It is responsive", "It is accessible"],
        "tags": ["nav", "bar", "menu", "site", "top"],
        "website_card": {
            "headline": "Navigation", "summary": "A bar that shows the main links.",
            "preview_label": "Nav", "search_keywords": ["nav"],
        },
        "quality": {
            "specificity_score": 8, "originality_score": 7,
            "implementation_clarity_score": 9, "website_readiness_score": 10,
        },
        "created_by_agent": "hand", "batch": "b1",
    }
    for key, value in changes.items():
        if value is ...:
            record.pop(key)
        else:
            record[key] = value
    return record


def write(path, files):
    path.mkdir(exist_ok=True)
    for name, lines in files.items():
        body = "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines)
        (path / name).write_text(body + "\n", encoding="utf-8")
    return str(path)
