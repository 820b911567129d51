"""Fixed values of the scoring rubric, the classifier and the text guards. They must be as they are for right results."""

# (id, weight, keywords), in configured order
TRACKS = [
    ("ai-agents", 1.3, ["agent", "agents", "mcp", "llm", "rag", "vibe coding", "copilot", "fine-tune", "inference", "prompt", "vector", "embedding"]),
    ("dev-tools", 1.1, ["sdk", "cli", "framework", "devtool", "ci", "observability", "database", "api", "open source", "self-host"]),
    ("saas-niche", 1.0, ["saas", "workflow", "automation", "crm", "billing", "compliance", "vertical", "b2b"]),
    ("fintech-crypto", 1.0, ["defi", "yield", "stablecoin", "onchain", "wallet", "payments", "fintech", "trading", "tokeniz"]),
    ("consumer-social", 0.9, ["creator", "social", "consumer", "mobile app", "community", "marketplace"]),
    ("hardware-iot", 0.9, ["hardware", "iot", "device", "robot", "sensor", "wearable", "edge"]),
]
EXCLUDE = ["crypto pump", "memecoin", "mlm", "nsfw", "giveaway airdrop"]
MACHINE_TYPES = {
    "tool-saas": ["saas", "tool", "platform", "dashboard", "api", "sdk", "app"],
    "marketplace": ["marketplace", "market", "directory", "aggregator", "two-sided"],
    "media": ["newsletter", "content", "media", "blog", "video", "podcast", "creator"],
    "service": ["agency", "service", "consult", "done-for-you", "managed"],
    "hardware": ["hardware", "device", "sensor", "robot", "wearable", "chip"],
    "arbitrage": ["arbitrage", "resell", "spread", "underpriced", "mispriced", "broker"],
    "oss-monetization": ["open source", "open-source", "oss", "self-host", "license", "managed hosting"],
}
FOCUS_TOPICS = ["open-source replacing paid API", "solo-founder-doable", "underpriced arbitrage"]
COMMUNITY_SOURCES = ["linux.do", "v2ex", "cn-feeds", "qbitai"]

DIMENSIONS = ("track_fit", "timing", "feasibility", "competition", "executability")
SUPPLY_WEIGHTS = (0.20, 0.25, 0.20, 0.15, 0.20)
DEMAND_WEIGHTS = (0.10, 0.10, 0.25, 0.30, 0.25)
LIFECYCLE = {"emerging": 1.0, "peak": 0.9, "declining": 0.75, "fading": 0.55}
HALF_LIFE_H, GRAVITY = 72.0, 1.8
CROWD_PENALTY, DEMAND_FRESH_FLOOR, DEMAND_BAR = 0.7, 0.6, 60.0
ARCHIVE_BAR, PUSH_BAR, MIN_SOURCES, MAX_PER_DAY = 55.0, 70.0, 2, 5
GRADES = [(85, "A"), (75, "B+"), (65, "B"), (55, "C+"), (45, "C")]

TOKEN = r"[a-z0-9][a-z0-9+.#-]*|[一-鿿぀-ヿ가-힯]+"
ALIAS = {"opendatalab-mineru": "mineru", "gpt4": "gpt-4", "gpt-4o": "gpt-4", "gpt4o": "gpt-4", "claude-3": "claude", "claude3": "claude", "llms": "llm", "agents": "agent"}
STOP = (
    "the a an of to for and or in on with show hn ask new release launch open source how why is are be it its your you this that we i my our "
    "using use used can will just now today vs via from into out up down get got make made build built app tool"
).split()

DUP_JACCARD, DUP_HAMMING, SOFT_JACCARD = 0.83, 3, 0.45
RESURFACE_JUMP, SAMPLES_CAP, LEDGER_TEXT = 15.0, 30, 400
WINDOW_DAYS, FLOOR, PRUNE_WEEKS, MIN_HISTORY_DAYS, PROPOSE_MIN, PRE_VIRAL_FAVES, NOISY_PULLS, NOISY_YIELD = 30, 0, 2, 7, 2, 500, 10, 0.1
DRIFT_TAU, DRIFT_CHURN, BLOCK_TAU, BLOCK_CHURN = 0.25, 0.20, 0.6, 0.5
PULSE_MAX_AGE_H, PULSE_CAP, PULSE_RETENTION_DAYS, HEAT_K = 72.0, 8, 14, 25.0

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
MENTION = r"<@!?(\d{15,21})>"
SNOWFLAKE = r"\b\d{17,20}\b"
INVITE = r"\b(?:https?://)?(?:discord\.gg|discord(?:app)?\.com/invite)/\S+"
URL = r"\bhttps?://\S+"
HANDLE = r"(?<![\w/])@([A-Za-z0-9_]{2,32})\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{0,4}::(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{0,4})(?![\w:.])"
PHONE = r"(?<!\w)(\+?\d[\d\s().-]{7,}\d)(?!\w)"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
SECRET = r"\b[A-Za-z0-9_\-]{24,}\b"
SECRET_ENTROPY = 3.5

RUN_SHAPES = [
    ("metrics-ledger", r"(?i)(^|/)metrics/.*\.(jsonl|ndjson)$"),
    ("runs-dir", r"(?i)(^|/)runs/"),
    ("dated-output", r"(?i)(^|/)(reports?|archive|digests?|logs?|out|output|state|snapshots?)/.*(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}(?!\d)|\d{8})"),
    ("output-ledger", r"(?i)(^|/)(archive|logs?|state|out|output|runs|reports?)/.*\.(jsonl|ndjson)$"),
    ("ledger-name", r"(?i)(^|/)(ledger|live-runs|events|dry-run|verdicts|opportunities|history|transcript|pulls-\d{4}-\d{2})\.(jsonl|ndjson)$"),
    ("state-name", r"(?i)(^|/)(escalation_state|fleet-check-status|bandit-state|throttle-state|dedup-state)\.json$"),
    ("database", r"(?i)\.(db|sqlite|sqlite3)$"),
]
SHAPE_EXEMPT = r"(?i)\.(example|sample|tmpl|template)(\.|$)"
SHINGLE_WORDS, MAX_DUP_PCT = 8, 2.0
