"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that a search ignores, kinds of file by extension, tracking parameters, hosts of known quality,
# words that name a kind of file or a default folder, and words that make a phrase say nothing.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "and", "or", "but", "if", "in", "on", "at", "to", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "from", "up", "down", "of", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "can", "will", "just", "don", "should", "now", "this", "that", "these", "those",
]
KINDS = {
    "document": ["pdf", "docx", "pptx", "csv", "xlsx", "xls", "txt", "md", "json", "xml", "html", "htm", "log", "tsv", "doc", "odt", "rtf"],
    "image": ["jpg", "jpeg", "png", "webp", "gif", "bmp", "heic", "heif", "tiff", "tif"],
    "video": ["mp4", "avi", "mov", "mkv", "webm", "m4v", "wmv", "mpg", "mpeg", "3gp"],
    "audio": ["mp3", "wav", "m4a", "ogg", "flac", "aac", "opus", "wma"],
}
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source"]
HIGH_QUALITY = [
    "gov", "edu", "nature.com", "science.org", "pubmed.ncbi.nlm.nih.gov", "scholar.google", "arxiv.org", "bbc.com", "reuters.com", "apnews.com", "nytimes.com",
    "theguardian.com", "who.int", "un.org",
]
GENERIC_FOLDERS = [
    "photo", "photos", "picture", "pictures", "pics", "pic", "image", "images", "img", "screenshots", "screenshot", "video", "videos", "movies", "clips", "audio",
    "music", "recordings", "voice", "document", "documents", "docs", "doc", "pdf", "pdfs", "files", "file", "folder", "new", "misc", "other", "others", "stuff",
    "dcim", "camera", "download", "downloads", "desktop", "users", "home", "data", "backup", "backups", "copy", "untitled", "tmp", "temp",
]
GENERIC_PHRASES = [
    "documents", "document", "downloads", "download", "pictures", "picture", "photos", "photo", "images", "image", "desktop", "new folder", "untitled", "scan",
    "scans", "img", "dcim", "camera", "screenshots", "misc", "files", "events", "event", "albums", "album", "backup", "backups", "gallery", "my pictures",
    "whatsapp images", "page", "pages", "chapter", "contents", "index", "abstract", "introduction", "copy", "final", "draft",
]
FILLER = [
    "wearing", "sitting", "standing", "large", "small", "people", "person", "group", "side", "background", "front", "room", "screen", "looking", "giving", "holding",
    "their", "they", "them", "there", "three", "four", "five", "white", "black", "left", "right", "smiling", "text", "hands", "hand", "table", "chairs", "chair",
    "woman", "women", "man", "men", "while", "behind", "several", "microphone", "microphones", "suit", "suits", "stage", "shows", "showing", "reads", "wooden",
    "portrait", "podium", "audience", "uniform", "clapping", "decorated", "projector", "banner", "image", "photo", "picture", "wall", "floor", "blue", "red",
    "green", "dark",
]
REPORT_WORDS = ["report", "policy", "study", "audit", "framework", "investigation"]
# Patterns: headings of pages, names of camera files and folders, names of folders that are dates, and lines that are no headings.
PAGE_HEADING = r"^(page\s*\d+|p\.?\s*\d+|\d+)$"
CAMERA_CODE = r"^(?:\d{2,3}[a-z]{2,}[a-z0-9_]*|(?:img|dsc|dscn|dscf|pxl|mvi|vid|p)[\s_-]?\d{3,}.*)$"
DATE_FOLDER = r"^(?:(?:19|20)\d{2}|\d{1,2}|\d{4}[-_.]\d{1,2}(?:[-_.]\d{1,2})?|\d{1,2}[-_.]\d{1,2}[-_.](?:19|20)?\d{2})$"
NOISE_LINES = [
    r"^\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}", r"(?i)^\d{1,2}:\d{2}(:\d{2})?\s*(am|pm)?$", r"(?i)^(https?://|\(?www\.|[a-z0-9.-]+\.[a-z]{2,}/?)", r"(?i)^(page\s*)?\d+(\s*(of|/)\s*\d+)?$",
    r"^[\p{Ll}\[(\-,;:]", r"(?i)^(and|or|but|because|with|that|which|not|to|for|in|on|at|by|from|into)\b",
]
# End of fixed values.


def tokens(text: Column, min_len: int = 1, drop_stopwords: bool = False) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))
    if min_len > 1:
        found = F.filter(found, lambda t: F.length(t) >= min_len)
    return F.filter(found, lambda t: ~t.isin(STOPWORDS)) if drop_stopwords else found


def search_terms(text: Column, most: int = 24) -> Column:
    """Distinct terms in order without stop words and single characters; all words where none is left."""
    every = F.array_distinct(tokens(text))
    some = F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))
    return F.slice(F.when(F.size(some) > 0, some).otherwise(every), 1, most)


def split_words(name: Column) -> Column:
    """Words of a folder or file name: parted at case changes and between letters and digits; stop words and single letters go."""
    s = F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(s, r"([^0-9\s_./-])([0-9])", "$1 $2"), r"([0-9])([^0-9\s_./-])", "$1 $2")
    return F.filter(tokens(s), lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]+$")) & ~t.isin(STOPWORDS))


def word_matches(query: Column, word: Column) -> Column:
    """Equal, or one of them begins with the other, which has four characters or more; numbers only match themselves."""
    number = query.rlike("^[0-9]+$") | word.rlike("^[0-9]+$")
    begins = F.when(F.length(query) <= F.length(word), (F.length(query) >= 4) & word.startswith(query)).otherwise((F.length(word) >= 4) & query.startswith(word))
    return (query == word) | (~number & begins)


def kind_of(ext: Column) -> Column:
    out = F.lit("unsupported")
    for kind, names in KINDS.items():
        out = F.when(F.lower(ext).isin(names), kind).otherwise(out)
    return out


def norm_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def record_title(title: Column) -> Column:
    """A title as a key: without a leading article, and of letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(title), r"(?i)^(the|a|an)\s+", "")), r"[^\p{L}\p{N}]", "")


def surname(author: Column) -> Column:
    """What stands before a comma, or else the last word, as a key."""
    name = F.trim(author)
    return record_title(F.when(name.contains(","), F.substring_index(name, ",", 1)).otherwise(F.element_at(F.split(name, r"\s+"), -1)))


def isbn13(isbn: Column) -> Column:
    """Digits of an ISBN as 13: ten digits get the prefix 978 and a new check digit; anything else is null."""
    bare = F.regexp_replace(F.upper(isbn), "[^0-9X]", "")
    core = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    total = F.lit(0)
    for i in range(12):
        total = total + F.substring(core, i + 1, 1).cast("int") * (1 if i % 2 == 0 else 3)
    made = F.concat(core, ((10 - total % 10) % 10).cast("string"))
    return F.when((F.length(bare) == 13) & ~bare.contains("X"), bare).when(bare.rlike("^[0-9]{9}[0-9X]$"), made)


def video_id(url: Column) -> Column:
    """The id in a YouTube address of any form, or an empty string."""
    return F.regexp_extract(url, r"(?i)(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/|live/)|youtu\.be/)([A-Za-z0-9_-]{6,})", 1)


def normalize_url(url: Column) -> Column:
    """``yt:`` and the id of a video; of another address, no scheme, ``www.``, query, fragment and trailing slashes, in small letters."""
    s = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^www\.", ""), r"[?#].*$", "")
    return F.when(video_id(url) != "", F.concat(F.lit("yt:"), video_id(url))).otherwise(F.regexp_replace(s, r"/+$", ""))


def canonical_url(url: Column) -> Column:
    """Keeps the query but its tracking parameters; drops the fragment and a trailing slash."""
    s = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    base, query = F.regexp_replace(s, r"\?.*$", ""), F.regexp_extract(s, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.regexp_replace(p, "=.*$", "").isin(TRACKING) & (p != "")), "&")
    base = F.regexp_replace(base, "/$", "")
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]+)", 1), r"^www\.", "")


def source_quality(url: Column, kind: Column | None = None) -> Column:
    """``high`` for papers, reports and known hosts, ``medium`` for other hosts, ``low`` where there is none."""
    host = domain(url)
    high = F.lit(False) if kind is None else F.coalesce(kind.isin("paper", "report"), F.lit(False))
    for mark in HIGH_QUALITY:
        high = high | host.contains(mark)
    return F.when(F.coalesce(host, F.lit("")) == "", "low").when(high, "high").otherwise("medium")


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags to blanks, common entities resolved, white space collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.ceil(F.length(text) / 3.8), F.ceil(F.size(tokens(text)) * 1.3)).cast("long")


def estimate_tokens_short(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def enriched(title: Column, text: Column) -> Column:
    return F.when(title.isNull() | (title == ""), text).otherwise(F.concat(F.lit("["), title, F.lit("] "), text))


def preview(text: Column, size: int = 150) -> Column:
    return F.substring(F.regexp_replace(text, r"^\[[^\]]*\] ", ""), 1, size)


def coverage(terms: list[str], text: Column) -> Column:
    """Share of terms that the text holds as substrings."""
    low = F.lower(text)
    return sum((F.when(low.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / max(len(terms), 1)


def clean_text(text: Column, size: int) -> Column:
    """Text of a field with mark-up: tags and entities resolved, and cut at a word with an ellipsis behind ``size`` characters."""
    s = strip_html(text)
    cut = F.substring(s, 1, size)
    at_word = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.length(s) <= size, s).otherwise(F.concat(F.when(at_word == "", cut).otherwise(at_word), F.lit("…")))


def keywords(text: Column, most: int = 10) -> Column:
    """The first distinct words of three characters or more that say something."""
    return F.slice(F.array_distinct(tokens(text, 3, drop_stopwords=True)), 1, most)


def without_words(text: Column, matched: Column) -> Column:
    """``text`` without the words all of whose tokens are in ``matched``."""
    words = F.filter(F.split(text, r"[\s/\\\\]+"), lambda w: w != "")
    return F.array_join(F.filter(words, lambda w: ~((F.size(split_words(w)) > 0) & F.forall(split_words(w), lambda t: F.array_contains(matched, t)))), " ")


def sentences(text: Column) -> Column:
    """Cut behind the ends of sentences in Latin and Indic scripts."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), "(?<=[.!?।॥])\\s+")


def extractive_summary(text: Column, count: int = 3, limit: int = 600) -> Column:
    """The first sentences of more than 25 characters, or else the begin of the text, with an ellipsis where it is cut."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]+\]\s*", ""), r"\s+", " "))
    long = F.slice(F.filter(sentences(clean), lambda s: F.length(s) > 25), 1, count)
    out = F.when(F.size(long) > 0, F.array_join(long, " ")).otherwise(F.substring(clean, 1, limit))
    return F.when(F.length(out) > limit, F.concat(F.rtrim(F.substring(out, 1, limit)), F.lit("…"))).otherwise(out)


def truncate_to_tokens(text: Column, most: int) -> Column:
    """Text that is estimated at over ``most`` tokens is cut at a sentence, or else a word, behind seven tenths of what fits, and says so."""
    size = int(most * 3.7)
    cut = F.substring(text, 1, size)
    end = F.greatest(*(F.when(cut.contains(m), F.length(cut) - F.locate(m[::-1], F.reverse(cut)) - 1).otherwise(-1) for m in (". ", ".\n", "? ", "! ")))
    word = F.when(cut.contains(" "), F.length(cut) - F.locate(" ", F.reverse(cut))).otherwise(-1)
    mark = "[truncated for token budget]"
    short = (F.when(end > size * 0.7, F.concat(F.substring(cut, F.lit(1), (end + 1).cast("int")), F.lit(f" {mark}")))
             .when(word > size * 0.7, F.concat(F.substring(cut, F.lit(1), word.cast("int")), F.lit(f"… {mark}"))).otherwise(F.concat(cut, F.lit(f"… {mark}"))))
    return F.when((estimate_tokens(text) <= most) | (F.length(text) <= size), text).otherwise(short)


def clean_phrase(text: Column, limit: int = 60) -> Column:
    """A phrase without marks around it and a leading article, cut at a word behind ``limit`` characters."""
    marks = r"[ \t\r\n\-_:;,.|#*]"  # marks at the end are looked for from their first one alone, as a phrase may hold long rows of them
    s = F.regexp_replace(F.regexp_replace(text, rf"^{marks}+|(?<!{marks}){marks}++$", ""), r"\s+", " ")
    s = F.regexp_replace(s, r"(?i)^(?:the|a|an)\s+", "")
    cut = F.substring(s, 1, limit)
    return F.rtrim(F.when(F.length(s) <= limit, s).when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut))


def is_generic(phrase: Column) -> Column:
    """Whether a phrase names nothing: a default folder, a page, a camera's file, too short, without a letter, or filler only."""
    low = F.trim(F.lower(phrase))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return (low.isin(GENERIC_PHRASES) | low.rlike(PAGE_HEADING) | (F.length(low) < 3) | ~low.rlike(r"\p{L}")
            | low.rlike(CAMERA_CODE) | F.forall(words, lambda w: w.isin(FILLER) | w.isin(STOPWORDS)))


def name_tokens(name: Column) -> Column:
    """A file's name without its extension, with blanks for the signs between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"[_\-.]+", " "))


def folder_topics(folder: Column) -> Column:
    """Names on a file's path that say something, the deepest first; dates and default folders don't."""
    parts = F.reverse(F.filter(F.split(F.translate(folder, "\\", "/"), "/"), lambda s: s != ""))
    phrases = F.transform(parts, lambda s: clean_phrase(F.regexp_replace(s, "_+", " ")))
    return F.filter(phrases, lambda p: ~p.rlike(DATE_FOLDER) & ~is_generic(p))


def title_score(query: Column, title: Column) -> Column:
    """How well a title answers a query, by their words: the same words, all of the query's, the whole title, or a share of them."""
    q, t = F.array_distinct(tokens(query, 2, drop_stopwords=True)), F.array_distinct(tokens(title, 2, drop_stopwords=True))
    shared, either = F.size(F.array_intersect(q, t)), F.size(F.array_union(q, t))
    j = shared / either
    return (F.when((F.size(q) == 0) | (F.size(t) == 0) | (shared == 0), 0.0).when(shared == either, 0.95).when(shared == F.size(q), 0.70 + 0.25 * j)
            .when((shared == F.size(t)) & (F.size(t) >= 2), 0.85).otherwise(0.45 * shared / F.size(q) + 0.35 * j))


def repaired_json(text: Column) -> Column:
    """JSON out of a model's answer: without thoughts and fences, from the first brace to the last, and without trailing commas."""
    s = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.regexp_replace(F.regexp_extract(s, r"(?s)(\{.*\})", 1), r",(\s*[}\]])", "$1")


def format_duration(seconds: Column) -> Column:
    """``m:ss``, or ``h:mm:ss`` from an hour on."""
    s = F.floor(seconds)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    short = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(s % 60))
    return F.when(s < 3600, short).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60)))


def parse_duration(text: Column) -> Column:
    """Seconds of an ISO 8601 duration of hours, minutes and seconds."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"^PT.*?(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def degrees(d: Column, m: Column, s: Column, side: Column) -> Column:
    """Degrees, minutes and seconds as a number, negative in the south and west."""
    value = d + m / 60 + s / 3600
    return F.when(F.upper(side).isin("S", "W"), -value).otherwise(value)


def face_quality(detection: Column, side: Column) -> Column:
    return F.round(detection * F.least(F.lit(1.0), side / 112), 4)


def is_undersized(width: Column, height: Column) -> Column:
    """Too small a picture to be searched by what it shows."""
    return (F.greatest(width, height) < 128) | (F.least(width, height) < 48)


def is_describable(kind: Column, width: Column, height: Column) -> Column:
    return (kind != "page") & (F.greatest(width, height) >= 160) & (F.least(width, height) >= 64)


def is_read_text(text: Column, chars: int = 20, words: int = 3) -> Column:
    """Whether what was read in a picture is enough to be kept."""
    return (F.length(F.trim(text)) >= chars) & (F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) >= words)


def is_within(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or lies below it, and doesn't lead out again."""
    return ((path == root) | path.startswith(root.rstrip("/") + "/")) & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def safe_path(path: Column) -> Column:
    """A relative path of safe names, without empty, ``.`` and ``..`` parts."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(F.transform(parts, safe_filename), "/")


def is_excluded(path: Column, kind: Column, rules: list[str]) -> Column:
    """Whether a rule holds: ``kind:x``, a path, a folder above it, or a pattern of ``*`` and ``?`` over the whole path."""
    out = F.lit(False)
    for rule in rules:
        if rule.startswith("kind:"):
            out = out | (kind == rule[5:])
        elif "*" in rule or "?" in rule:
            out = out | path.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c for c in rule) + "$")
        else:
            out = out | (path == rule) | path.startswith(rule.rstrip("/") + "/")
    return out


def format_bytes(size: Column) -> Column:
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(F.round(size / 1024, 1).cast("string"), F.lit(" KB")))
            .otherwise(F.concat(F.round(size / 1048576, 1).cast("string"), F.lit(" MB"))))


def safe_filename(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\.+$", ""))


def is_noise_header(line: Column) -> Column:
    """Whether a line is no heading: too short or long, a date, a time, an address, a page number, or the middle of a sentence."""
    s = F.trim(line)
    noise = (F.length(s) < 3) | (F.length(s) > 110)
    for pattern in NOISE_LINES:
        noise = noise | s.rlike(pattern)
    return noise
