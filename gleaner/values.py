"""Word lists, prefixes and formats that results depend on."""

# --- fixed values: statuses of a ledger row ---
PENDING, DOWNLOADED, FAILED, SKIPPED_MEDIUM = "pending", "downloaded", "failed", "skipped_medium"

# --- fixed values: sites and URL prefixes ---
BLOG_PREFIX = "https://www.databricks.com/blog/"
BLOG_BASE = "https://www.databricks.com"
BLOG_NEW_DATA = "/en-blog-assets/page-data/blog/"
BLOG_LEGACY_DATA = "/blog-legacy-assets/page-data/blog/"
BLOG_DATA_FILE = "/page-data.json"
BLOG_SITEMAP_KEYWORDS = ["en-blog-assets", "blog-legacy-assets"]
GLOSSARY_PREFIX = "https://www.databricks.com/glossary/"
SECOND_BLOG_PREFIXES = [
    "https://www.snowflake.com/en/blog/",
    "https://www.snowflake.com/blog/",
]
LISTING_SEGMENTS = ["page", "category", "tag", "author"]
SECOND_LISTING_SEGMENTS = ["page", "category", "tag", "author", "wp-json", "feed", "archive"]
MEDIUM_DOMAINS = [
    "towardsdatascience.com",
    "betterprogramming.pub",
    "levelup.gitconnected.com",
    "javascript.plainenglish.io",
    "blog.devgenius.io",
    "python.plainenglish.io",
    "itnext.io",
    "blog.bitsrc.io",
    "medium.datadriveninvestor.com",
    "betterhumans.pub",
    "entrepreneurshandbook.co",
]
YOUTUBE_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be"]
SHORT_LINK_HOSTS = ["search.app", "share.google"]
NOVEL_SITES = ["lightnovelstranslations.com", "freewebnovel.com", "novelbin.com", "webnovel.com"]
IMPORT_USER = "_raindrop_import"
CLOUDS = ["aws", "gcp", "azure"]
IMAGE_BASE = "https://cdn-images-1.medium.com/max/1024/"
NOVEL_URL_TEMPLATES = {
    "my dragon system": "https://freewebnovel.com/novel/my-dragon-system/chapter-{chapter}",
    "my vampire system": "https://freewebnovel.com/novel/my-vampire-system/chapter-{chapter}",
    "my werewolf system": "https://freewebnovel.com/novel/my-werewolf-system/chapter-{chapter}",
    "rezero kara hajimeru isekai seikatsu wn":
        "https://freewebnovel.com/novel/rezero-kara-hajimeru-isekai-seikatsu-wn/chapter-{chapter}",
    "rezero all sins": "https://freewebnovel.com/novel/rezero-all-sins/chapter-{chapter}",
    "reincarnated with the strongest system":
        "https://freewebnovel.com/novel/reincarnated-with-the-strongest-system/chapter-{chapter}",
}
NOVEL_URL_BASE = "https://freewebnovel.com/novel/"

# --- fixed values: phrases that mark a paragraph as boilerplate, per site ---
BOILERPLATE = {
    "lightnovelstranslations.com": [
        "prev chapter", "next chapter", "translator:", "editor:", "patreon", "kofi",
        "adsbygoogle", "bookmark", "comment", "report", "login",
    ],
    "freewebnovel.com": [
        "prev chapter", "next chapter", "freewebnovel.com", "report chapter",
        "tap the screen", "log in",
    ],
    "novelbin.com": ["prev", "next", "comment", "novelbin"],
    "offset": [
        "prev chapter", "next chapter", "use arrow keys", "report chapter",
        "freewebnovel.com", "contact", "sitemap", "privacy policy", "log in",
        "create account", "tap the screen", "add to library", "submit", "comments",
        "welcome to freewebnovel", "don't have an account",
    ],
}
BOILERPLATE_HEAD = {"novelbin.com": 50}

# --- fixed values: where each novel site keeps a chapter's title and text, in order ---
# A name with a dot is a class, with a hash an id, else a tag.
CHAPTER_TITLES = {
    "lightnovelstranslations.com": ["h2", "h1.entry-title", ".entry-title", "h1"],
    "freewebnovel.com": ["h1.tit", ".chapter-title", "h1"],
    "novelbin.com": [".chr-title", "h1"],
    "webnovel.com": ["h3.cha-tit", ".chapter-title", "h1"],
}
CHAPTER_TEXTS = {
    "lightnovelstranslations.com": [".text_story", ".entry-content", ".post-content", ".chapter-content", "article"],
    "freewebnovel.com": [],
    "novelbin.com": ["#chr-content", ".chr-c", "#chapter-content"],
    "webnovel.com": [".cha-words", ".cha-content", ".chapter-content"],
}
CHAPTER_GATES = {
    "lightnovelstranslations.com": 50, "freewebnovel.com": 100, "novelbin.com": 50, "webnovel.com": 50,
}

# --- fixed values: length gates ---
MIN_PARAGRAPH = 15
MIN_HTML = 50
MIN_ARTICLE = 100
MIN_DOC = 20
MIN_CHAPTER = 50
MIN_VISIBLE = 200
MIN_PARAGRAPHS_JSON = 3
ERROR_HTML_CHARS = 5000
PREVIEW_CHARS = 200

# --- fixed values: note markers and templates ---
NAV_MARKER = "<!-- nav-footer -->"
SERIES_MARKER = "\n---\n\n**Series Navigation**"

# --- fixed values: roman part numbers ---
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}

# --- fixed values: callout words, in order of precedence ---
CALLOUTS = {
    "note": "NOTE", "info": "NOTE", "information": "NOTE",
    "warning": "WARNING", "warn": "WARNING", "caution": "WARNING",
    "important": "IMPORTANT", "danger": "WARNING",
    "tip": "TIP", "hint": "TIP",
}
CALLOUT_LABELS = ["Note", "Warning", "Important", "Tip", "Caution", "Info"]
MDX_CALLOUTS = {"Info": "NOTE", "Tip": "TIP", "Warning": "WARNING", "Caution": "WARNING"}
MDX_CONTAINERS = ["Tabs", "AccordionGroup", "CardGroup", "Card", "Steps", "Step", "Note", "Frame"]

# --- fixed values: characters a file name must not hold ---
UNSAFE = '<>:"/\\|?*'
UNSAFE_IN_SEGMENT = '<>:"|?*'

# --- fixed values: component Markdown: page index, titled blocks, containers, any other component ---
MDX_INDEX = r"(?s)\A>\s*##\s*Documentation Index.*?(?=\n#|\z)"
MDX_TITLED = r'(?s)<{tag}\s+[^>]*title="([^"]+)"[^>]*>\s*(.*?)\s*</{tag}>'
MDX_CONTAINER = r"</?(?:{names})(?:\s[^>]*)?\s*/?>"
MDX_OTHER = r"<[A-Z][A-Za-z]*(?:\s[^>]*)?\s*/?>|</[A-Z][A-Za-z]*>"

# --- fixed values: titles that name a part of a series, in order ---
SERIES_FORMS = [
    r"^(.*?)\s*[:\-—–]?\s*Part\s+(I{1,3}V?|VI{0,3}|IX|X)\s+of\s+\w+\s*$",
    r"^(.*?)\s*[:\-—–]\s*Part\s+(I{1,3}V?|VI{0,3}|IX|X)\s*$",
    r"^(.*?)\s*[:\-—–]\s*Part\s+(\d+)(?:\s+of\s+\d+)?\s*$",
    r"^(.*?)\s*\(Part\s+(I{1,3}V?|VI{0,3}|IX|X|\d+)\)\s*$",
]

# Every character str.strip() removes, from the rule itself.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
