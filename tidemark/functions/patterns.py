"""Fixed values that results depend on: lists, patterns and limits. Order matters where the first match wins."""

# fixed values: crawl policy
HARD_EXCLUDED_PATHS = ("/checkout", "/cart", "/login", "/signin", "/sign-in", "/register", "/signup", "/sign-up", "/account", "/payment", "/admin", "/logout", "/wp-admin")
SKIP_EXTENSIONS = (
    ".pdf", ".zip", ".mp4", ".mp3", ".dmg", ".exe", ".apk",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".css", ".js", ".map", ".xml.gz", ".tar", ".gz", ".rar", ".7z",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
PROBE_PATHS = ("/llms.txt", "/sitemap.xml", "/.well-known/mcp.json", "/.well-known/agent.json", "/.well-known/ai-plugin.json", "/.well-known/security.txt", "/openapi.json", "/swagger.json", "/api-docs")
INTERACTIVE_PAGES, BATCH_PAGES, SECONDS_PER_REQUEST, MAX_HTML = 12, 40, 2.0, 3_000_000

# fixed values: identifiers and pagination
ID_PROPERTIES = ("sku", "productID", "productId", "gtin", "gtin8", "gtin12", "gtin13", "gtin14", "mpn", "isbn", "identifier", "serialNumber", "orderNumber")
ID_QUERY_KEYS = ("id", "pid", "sku", "product_id", "productid", "listing_id", "item", "itemid", "ref")
ID_CONTAINERS = (
    "product", "products", "p", "item", "items", "listing", "listings",
    "property", "properties", "car", "cars", "vehicle", "hotel", "hotels",
    "room", "sku", "detail", "details", "dp", "offer", "offers",
)
PAGE_QUERY_KEYS = ("page", "p", "pg", "offset", "start", "from", "skip", "cursor")
PAGE_PATH = r"(?i)/(page|p)[/-]?([0-9]+)/?$"
INFINITE_SCROLL = r"(?i)(infinite[-_\s]?scroll|data-infinite|IntersectionObserver|load[-_\s]?more|loadMore|showMore|data-load-more|react-infinite|vue-infinite-loading|scroll-?trigger-?load)"

# fixed values: headers
RATE_LIMIT_HEADERS = ("retry-after", "ratelimit", "ratelimit-limit", "ratelimit-remaining", "ratelimit-reset", "ratelimit-policy", "x-ratelimit-limit", "x-ratelimit-remaining", "x-ratelimit-reset", "x-rate-limit-limit")
AUTH_HEADERS = ("www-authenticate", "x-api-key", "authorization")
CHALLENGE_HEADERS = ("cf-mitigated", "x-datadome", "x-px-block")
CAPTCHA = r"(?i)(recaptcha|hcaptcha|turnstile|cf-challenge|challenge-platform|px-captcha|perimeterx|datadome|incapsula|distil_r_captcha|just\s+a\s+moment|checking\s+your\s+browser|verify\s+you\s+are\s+human|enable\s+javascript\s+and\s+cookies\s+to\s+continue)"
RESPONSE_HEADERS = ("content-type", "server", "cache-control", "x-powered-by", "vary", "content-language", "x-robots-tag")

# fixed values: prices, availability, governance
CURRENCY = r"(?:AED|د\.إ|SAR|QAR|KWD|BHD|OMR|USD|EUR|GBP|INR|\$|€|£|₹|¥)"
RENDERED_PRICE = rf"(?i)(?:{CURRENCY}\s?[0-9][0-9,]*(?:\.[0-9]{{1,2}})?|[0-9][0-9,]*(?:\.[0-9]{{1,2}})?\s?{CURRENCY})"
RENDERED_AVAILABILITY = r"(?i)\b(in stock|out of stock|sold out|available now|unavailable|back ?order|pre-?order|limited availability|only [0-9]+ left|ships? (?:in|within))\b"
PRICE_KEYS = ("price", "lowPrice", "highPrice", "priceCurrency", "priceSpecification")
AVAILABILITY_KEYS = ("availability", "availabilityStarts", "inventoryLevel", "itemCondition")
LEGAL_PATH = r"(?i)/(terms|tos|terms-of-(service|use)|legal|conditions|acceptable-use|aup|robots-policy|crawling|scraping)(/|$|\.)"
DEVELOPER_PATH = r"(?i)/(developer|developers|api|apis|api-reference|api-docs|docs|documentation|dev-portal|integrations?)(/|$|\.)"
AGENT_TERMS = (
    r"(?i)\b(automated (access|means|system|tool|agent|process|quer(?:y|ies)|method)|web ?(crawler|crawling|scraper|scraping|spider|robot)|"
    r"data (mining|harvesting|extraction|scraping)|bots?\b[^.!?]{0,40}\b(access|permitted|prohibited|allowed|use)|"
    r"artificial intelligence[^.!?]{0,60}\b(train|training|model|dataset)|machine learning[^.!?]{0,60}\b(train|training|dataset)|"
    r"(ai|llm|generative)[^.!?]{0,30}\btraining\b|robots\.txt|text and data mining)\b"
)
MACHINE_AUTH = r"(?i)\b(api[- ]key|api[- ]token|access[- ]token|bearer[- ]token|client[- ](id|secret)|oauth\s*2(\.0)?|personal access token|service account|authorization header|x-api-key)\b"

# fixed values: injection patterns (id, category, severity, pattern)
INJECTION = (
    ("ignore_previous", "instruction_override", "high", r"\b(ignore|disregard|forget|override)\b[^.!?\n]{0,40}\b(previous|prior|above|earlier|preceding|all)\b[^.!?\n]{0,20}\b(instruction|instructions|prompt|prompts|direction|directions|rule|rules|context)\b"),
    ("role_redefinition", "role_redefinition", "high", r"\b(you\s+are\s+now|from\s+now\s+on\s+you|act\s+as\s+(?:a|an|the)|pretend\s+(?:to\s+be|you\s+are)|your\s+new\s+(?:role|task|instructions?)\s+(?:is|are))\b"),
    ("system_prompt_spoof", "role_redefinition", "high", r"(^|\n|>)\s*(\[|\{|<|#{1,3}\s*)?\s*(system|assistant|developer)\s*(prompt|message|instruction)?\s*[:\]\}>]"),
    ("agent_directive", "agent_directive", "high", r"\b(ai|llm|language\s+model|assistant|agent|chatbot|bot|crawler|scraper|chatgpt|claude|gemini|copilot|perplexity)\b\s*[,:]\s*(please\s+)?\b(ignore|note|remember|recommend|rank|rate|say|tell|report|output|respond|reply|include|prioriti[sz]e|summari[sz]e|do|always|never|you\s+must)\b"),
    ("ranking_manipulation", "ranking_manipulation", "high", r"\b(rank|rate|score|classify|mark|report|list)\b[^.!?\n]{0,50}\b(this\s+(?:site|page|company|business|product|listing)|us|our\s+\w+)\b[^.!?\n]{0,50}\b(highest|first|top|best|100|perfect|maximum|number\s+one|fully\s+compliant|agent[- ]ready)\b"),
    ("exfiltration", "exfiltration", "high", r"\b(send|post|forward|transmit|upload|leak|reveal|disclose|include)\b[^.!?\n]{0,60}\b(system\s+prompt|api[_\s-]?key|secret|token|credential|password|conversation|chat\s+history|previous\s+messages)\b"),
    ("tool_invocation", "tool_invocation", "high", r"(<\s*(tool_call|function_call|invoke|antml:invoke|tool_use)\b|\b(call|invoke|execute|run)\s+the\s+\w+\s+(tool|function|command)\b)"),
    ("instruction_delimiter_spoof", "instruction_override", "medium", r"(-{3,}\s*(end|begin|start)\s+of\s+(instructions?|prompt|context|document)\s*-{3,}|<\s*/?\s*(system|instructions?|untrusted_\w+|user_input)\s*>)"),
    ("urgency_authority", "social_engineering", "medium", r"\b(this\s+is\s+(?:an?\s+)?(?:official|authorized|approved|urgent)|the\s+(?:user|developer|administrator|owner)\s+has\s+(?:already\s+)?(?:approved|authori[sz]ed|permitted|requested))\b"),
)
ZERO_WIDTH = "​‌‍⁠﻿᠎"
BIDI = "‪‫‬‭‮⁦⁧⁨⁩"
MIN_PAYLOAD = 12
HIDDEN_STYLE = r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\b|font-size\s*:\s*0|clip\s*:\s*rect\(0|(?:left|top|text-indent)\s*:\s*-\s*[0-9]{3,}\s*(?:px|em|%))"
HIDDEN_CLASSES = ("sr-only", "visually-hidden", "screen-reader", "hidden")
SUSPICIOUS_ATTRIBUTES = ("alt", "title", "aria-label", "placeholder", "data-tooltip", "content")

# fixed values: capabilities
STATE_CHANGING = (
    "book", "buy", "purchase", "order", "reserve", "cancel", "submit", "pay",
    "checkout", "create", "delete", "update", "register", "subscribe", "apply",
    "send", "post", "add", "remove", "modify", "schedule", "enrol", "enroll",
)
CAPABILITY_KINDS = ("openapi", "wellknown", "form", "identifier", "jsonld", "microdata", "llmstxt", "sitemap", "link", "text")
ABSENCE_MARKERS = ("#absent", "#no-spec", "#none", "#unavailable", "#clean", "#not-a-manifest", "#not-markdown", "#not-a-spec", "#unreachable", "#insufficient-content", "#unparseable", "#silent-on-automation")
MAX_INDUCED_ROWS, MAX_INDUCED_CHARS, MAX_INDUCED_ROW = 60, 40_000, 900
BANDS = ("Invisible", "Emerging", "Readable", "Agent-Ready", "Agent-Native")
