"""The closed taxonomy of labels and the small dimensions. All values here are fixed values.

`assistant` stands for the fleet's own assistant, whose sessions come from the openclaw transcripts; DISPLAY_NAMES and
DELEGATE_TARGETS can be replaced where a fleet calls it otherwise.
"""

from __future__ import annotations

TAXONOMY_VERSION = 4
PROMPT_VERSION = 1
OTHER = "other"
NONE = "none"

ASKING = [
    "facts_or_lookup", "how_to_guidance", "learning_or_explanation", "news_or_current_events", "product_or_purchase_research",
    "health_or_wellbeing", "decision_support", "multi_source_synthesis", "troubleshooting_or_diagnosis",
    "codebase_or_system_understanding", "library_or_docs_lookup",
]
DOING = [
    "write_code", "modify_or_debug_code", "review_or_critique", "write_prose", "edit_or_rewrite", "translate_or_localize",
    "summarize_or_extract", "analyze_data", "automate_or_script", "configure_or_setup", "create_media", "plan_or_organize",
    "draft_communication", "brainstorm_or_ideate",
]
EXPRESSING = ["personal_or_reflective", "casual_conversation"]
INTENTS = [*ASKING, *DOING, *EXPRESSING, OTHER]

DOMAIN_TITLES = {
    "software_engineering": "Software Engineering", "data_and_analytics": "Data & Analytics", "infrastructure_and_devops": "Infra & DevOps",
    "security": "Security", "product_and_design": "Product & Design", "research_and_science": "Research", "business_and_finance": "Business & Finance",
    "marketing_and_sales": "Marketing & Sales", "legal_and_compliance": "Legal & Compliance", "people_and_hiring": "People & Hiring",
    "education_and_learning": "Learning", "health_and_medicine": "Health", "personal_and_lifestyle": "Personal", "creative_and_media": "Creative & Media",
    "customer_support": "Customer Support", "operations_and_admin": "Ops & Admin",
}
DOMAINS = [*DOMAIN_TITLES, OTHER]
DELEGATIONS = [NONE, "tool_call", "agent_run"]
DELEGATE_TARGETS = [NONE, "assistant", "claude_code", "codex", "claude", "chatgpt", "gemini", "copilot", "cursor", "devin", OTHER]
MIN_DEPTH, MAX_DEPTH = 1, 4

DISPLAY_NAMES = {"openclaw": "Assistant", "claude-code": "Claude Code", "codex": "Codex", "chatgpt-web": "ChatGPT", "claude-web": "Claude", "gemini-web": "Gemini"}
WEB_TOOLS = {"chatgpt-web": "openai", "claude-web": "anthropic", "gemini-web": "google"}
APP_LABELS = {"mail.google.com": "Gmail", "drive.google.com": "Drive", "docs.google.com": "Docs", "sheets.google.com": "Sheets", "slides.google.com": "Slides", "calendar.google.com": "Calendar"}
MODEL_PREFIXES = [("claude", "anthropic"), ("gpt", "openai"), ("o1", "openai"), ("o3", "openai"), ("o4", "openai"), ("chatgpt", "openai"), ("text-embedding", "openai"), ("gemini", "google"), ("palm", "google")]
