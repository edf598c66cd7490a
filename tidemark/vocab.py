"""Values that results depend on: enumerations, synonym tables, defaults, limits.

Every operator takes these as parameters; the constants below are the defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Record fields and enumerations.
# ---------------------------------------------------------------------------
RECORD_FIELDS = (
    "id", "version", "category", "subcategory", "title", "slug",
    "language", "difficulty", "audience", "use_case", "industry",
    "style", "tech_stack", "prompt", "negative_prompt",
    "acceptance_criteria", "tags", "website_card", "quality",
    "created_by_agent", "batch",
)
STYLE_FIELDS = ("visual_style", "layout_style", "color_direction", "motion_style")
TECH_REQUIRED_FIELDS = ("framework", "language", "styling")
TECH_FIELDS = ("framework", "language", "styling", "animation", "optional_libraries")
CARD_FIELDS = ("headline", "summary", "preview_label", "search_keywords")
SCORE_FIELDS = (
    "specificity_score", "originality_score",
    "implementation_clarity_score", "website_readiness_score",
)

CATEGORIES = (
    "landing_pages", "ui_components", "saas_dashboards", "ecommerce",
    "portfolio_personal_brand", "ai_tools_agents", "education_learning",
    "mobile_apps", "games_interactive", "data_visualization",
)
DIFFICULTIES = ("beginner", "intermediate", "advanced", "expert")
LANGUAGES = ("en", "de")
AUDIENCES = (
    "frontend_developer", "fullstack_developer", "designer",
    "product_designer", "founder", "marketer", "teacher",
    "content_creator", "ai_builder", "game_developer",
)
USE_CASES = (
    "website_generation", "component_generation", "app_generation",
    "dashboard_generation", "design_system_generation",
    "animation_generation", "copywriting_plus_ui", "educational_interface",
    "game_ui_generation", "data_visualization",
)

# ---------------------------------------------------------------------------
# Synonym tables (observed value -> enumeration member).
# ---------------------------------------------------------------------------
AUDIENCE_SYNONYMS = {
    "web_developer": "frontend_developer",
    "ui_designer": "designer",
    "ux_designer": "designer",
    "indie_hacker": "founder",
    "startup_founder": "founder",
    "developer": "frontend_developer",
    "backend_developer": "fullstack_developer",
    "software_engineer": "fullstack_developer",
    "graphic_designer": "designer",
    "motion_designer": "designer",
    "brand_designer": "designer",
    "web_designer": "designer",
    "digital_marketer": "marketer",
    "growth_hacker": "marketer",
    "seo_specialist": "marketer",
    "social_media_manager": "content_creator",
    "youtuber": "content_creator",
    "blogger": "content_creator",
    "podcaster": "content_creator",
    "influencer": "content_creator",
    "streamer": "content_creator",
    "student": "teacher",
    "educator": "teacher",
    "professor": "teacher",
    "instructor": "teacher",
    "tutor": "teacher",
    "parent": "teacher",
    "data_scientist": "ai_builder",
    "ml_engineer": "ai_builder",
    "ai_researcher": "ai_builder",
    "prompt_engineer": "ai_builder",
    "narrative_designer": "game_developer",
    "level_designer": "game_developer",
    "game_designer": "game_developer",
    "product_manager": "product_designer",
    "project_manager": "product_designer",
    "scrum_master": "product_designer",
    "agile_coach": "product_designer",
    "devops_engineer": "fullstack_developer",
    "sre": "fullstack_developer",
    "cloud_engineer": "fullstack_developer",
    "security_engineer": "fullstack_developer",
    "blockchain_developer": "fullstack_developer",
    "mobile_developer": "frontend_developer",
    "react_developer": "frontend_developer",
    "vue_developer": "frontend_developer",
    "angular_developer": "frontend_developer",
    "svelte_developer": "frontend_developer",
}
USE_CASE_SYNONYMS = {
    "ui_generation": "component_generation",
    "web_app_generation": "app_generation",
    "landing_page_generation": "website_generation",
    "dashboard_ui": "dashboard_generation",
    "design_generation": "design_system_generation",
    "motion_design": "animation_generation",
    "content_generation": "copywriting_plus_ui",
    "learning_interface": "educational_interface",
    "game_design": "game_ui_generation",
    "chart_generation": "data_visualization",
    "visualization": "data_visualization",
}
CATEGORY_SYNONYMS = {
    "landing_page": "landing_pages",
    "landingpage": "landing_pages",
    "ui_component": "ui_components",
    "uicomponent": "ui_components",
    "component": "ui_components",
    "saas_dashboard": "saas_dashboards",
    "dashboard": "saas_dashboards",
    "ecommerce": "ecommerce",
    "e_commerce": "ecommerce",
    "shop": "ecommerce",
    "portfolio": "portfolio_personal_brand",
    "personal_brand": "portfolio_personal_brand",
    "ai_tool": "ai_tools_agents",
    "ai_agent": "ai_tools_agents",
    "ai": "ai_tools_agents",
    "education": "education_learning",
    "learning": "education_learning",
    "mobile_app": "mobile_apps",
    "mobile": "mobile_apps",
    "game": "games_interactive",
    "interactive": "games_interactive",
    "data_viz": "data_visualization",
    "data": "data_visualization",
    "visualization": "data_visualization",
    "chart": "data_visualization",
}
DIFFICULTY_SYNONYMS = {
    "easy": "beginner",
    "simple": "beginner",
    "novice": "beginner",
    "medium": "intermediate",
    "moderate": "intermediate",
    "hard": "advanced",
    "complex": "advanced",
    "challenging": "advanced",
    "master": "expert",
    "professional": "expert",
    "enterprise": "expert",
}
CATEGORY_DEFAULT = "landing_pages"
AUDIENCE_DEFAULT = "frontend_developer"
USE_CASE_DEFAULT = "website_generation"
DIFFICULTY_DEFAULT = "intermediate"
LANGUAGE_DEFAULT = "en"

# ---------------------------------------------------------------------------
# Defaults written into incomplete records.
# ---------------------------------------------------------------------------
STYLE_DEFAULTS = {
    "visual_style": "clean modern minimal design",
    "layout_style": "responsive grid layout",
    "color_direction": "neutral palette with accent colors",
    "motion_style": "subtle transitions and micro-interactions",
}
TECH_DEFAULTS = {
    "framework": "React",
    "language": "TypeScript",
    "styling": "Tailwind CSS",
    "animation": "Framer Motion",
    "optional_libraries": ["lucide-react"],
}
CARD_DEFAULTS = {
    "headline": "UI Component Prompt",
    "summary": "A production-ready prompt for building a modern UI component.",
    "preview_label": "UI",
    "search_keywords": ["UI", "component", "React"],
}
SCORE_DEFAULTS = {
    "specificity_score": 8,
    "originality_score": 8,
    "implementation_clarity_score": 8,
    "website_readiness_score": 9,
}
CRITERIA_DEFAULTS = (
    "Component renders correctly with all interactive elements",
    "Layout is responsive across all screen sizes",
    "Design matches the specified visual style and color direction",
)
PROMPT_PADDING = (
    " Ensure the implementation is production-ready with proper error handling, "
    "loading states, and accessibility features. Use semantic HTML elements and ARIA "
    "attributes where appropriate. Test the component across multiple browsers and devices."
)
NEGATIVE_PROMPT_DEFAULT = (
    "Avoid generic templates, placeholder content, and inconsistent styling. "
    "Do not skip responsive behavior or accessibility requirements."
)
TAG_MERGE_DEFAULTS = ("react", "tailwind")
TAG_PAD_DEFAULTS = ("react", "tailwind", "ui", "component")
VERSION_DEFAULT = "1.0.0"
SUBCATEGORY_DEFAULT = "general"
INDUSTRY_DEFAULT = "saas"
AGENT_SUFFIX = "_agent"
BATCH_SUFFIX = "_001"
UNTITLED_PREFIX = "Untitled Prompt "
UNTITLED_SLUG_SOURCE = "untitled"

# ---------------------------------------------------------------------------
# Limits and formats.
# ---------------------------------------------------------------------------
ID_PREFIX = "PRM-"
ID_LENGTH = 10
ID_PATTERN = "^PRM-[0-9]{6}$"
VERSION_PATTERN = r"^[0-9]+\.[0-9]+\.[0-9]+$"
KEBAB_PATTERN = "^[a-z0-9]+(-[a-z0-9]+)*$"
PROMPT_WORDS = (80, 220)
NEGATIVE_WORDS_MAX = 60
CRITERIA_ITEMS = (3, 6)
TAG_ITEMS = (5, 12)
SCORE_RANGE = (1, 10)
OPENING_WORDS = 5
OPENING_MAX_USES = 5
SENTENCE_FALLBACK_CHARS = 100
PAIR_WINDOW = 49
PAIR_THRESHOLD = (7, 10)  # similarity must be strictly above 7/10
MIN_TOTAL = 10000
MIN_CATEGORIES = 10
MIN_PER_CATEGORY = 1000
PAGE_SIZE = 48
TOP_N = {"framework": 14, "animation": 12, "styling": 8, "industry": 16}
REPORT_ERRORS_MAX = 500
REPORT_DETAILS_MAX = 50
REPORT_PAIRS_MAX = 100
REPORT_SENTENCE_IDS_MAX = 10

# ---------------------------------------------------------------------------
# Words ignored by the duplicate fingerprint.
# ---------------------------------------------------------------------------
STOPWORDS = tuple(
    """
    a an the and or but in on at to for
    of with by from as is was are be been
    being have has had do does did will would
    could should may might must shall can need
    dare ought used this that these those i me
    my we our you your he him his she her
    it its they them their what which who when
    where why how all any both each few more
    most other some such no nor not only own
    same so than too very just also get use
    using build create design make implement
    generate produce develop render construct deliver
    """.split()
)

# ---------------------------------------------------------------------------
# Display dimensions. The first category and "intermediate" are
# the fallbacks for unknown keys.
# ---------------------------------------------------------------------------
CATEGORY_DIMENSION = (
    ("landing_pages", "Landing Pages", "Heroes, SaaS-Homepages, Product-Launches & Conversion-Pages."),
    ("ui_components", "UI Components", "Navbars, Cards, Modals, Bento-Grids, Forms & mehr."),
    ("saas_dashboards", "SaaS Dashboards", "Admin, Analytics, CRM, Finance & AI-Ops Dashboards."),
    ("ecommerce", "E-Commerce", "Product-Pages, Shops, Checkout-Flows & Marktplätze."),
    ("portfolio_personal_brand", "Portfolio & Brand", "Developer-, Designer- & Founder-Portfolios."),
    ("ai_tools_agents", "AI Tools & Agents", "Agent-UIs, Chat-Interfaces & Workflow-Builder."),
    ("education_learning", "Education & Learning", "Lernplattformen, Kurse, Quizze & Flashcards."),
    ("mobile_apps", "Mobile Apps", "Onboarding, Tracker, Finance, Fitness & AI-Companions."),
    ("games_interactive", "Games & Interactive", "Game-Landings, HUDs, Idle-Games & gamified Apps."),
    ("data_visualization", "Data Visualization", "Charts, Infografiken, Maps, KPI-Boards & Timelines."),
)
DIFFICULTY_DIMENSION = (
    ("beginner", "Beginner", 1),
    ("intermediate", "Intermediate", 2),
    ("advanced", "Advanced", 3),
    ("expert", "Expert", 4),
)
