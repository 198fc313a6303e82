"""Canonical schemas, as DDL strings."""

USAGE = (
    "tenant string, provider string, file_path string, line_no long, epoch long, model string, "
    "input long, output long, cache_creation long, cache_read long, dedup_key string"
)
COUNTERS = ["input", "output", "cache_creation", "cache_read"]
DAILY = (
    "tenant string, provider string, day string, input_tokens long, output_tokens long, cache_creation_tokens long, "
    "cache_read_tokens long, total_tokens long, total_cost double, models array<string>"
)
PRICES = "model string, input double, output double, cache_creation double, cache_read double"
VENDORS = "vendor string, display_name string, provider string"
PLANS = "vendor string, plan string, label string, preset_fee double"
SETTINGS = "tenant string, vendor string, plan string, custom_fee double"
MANIFEST = "path string, mtime long, size long, run long"

# Vendors and their providers.
VENDOR_ROWS = [("claude", "Claude", "claude-native"), ("gpt", "GPT", "codex")]

# Subscription plans and their monthly fees in USD; no fee where usage is billed or the user says.
PLAN_ROWS = [
    ("claude", "api", "API (pay-as-you-go)", None),
    ("claude", "pro", "Pro · $20/mo", 20.0),
    ("claude", "max5x", "Max 5× · $100/mo", 100.0),
    ("claude", "max20x", "Max 20× · $200/mo", 200.0),
    ("claude", "custom", "Custom…", None),
    ("gpt", "api", "API (pay-as-you-go)", None),
    ("gpt", "plus", "Plus · $20/mo", 20.0),
    ("gpt", "pro", "Pro · $200/mo", 200.0),
    ("gpt", "custom", "Custom…", None),
]
