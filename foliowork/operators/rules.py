"""Rules over metadata and evidence: formats, routes, budgets, limits, names, states and search.

Rule tables are small fixed dimensions; they are joined as broadcast tables or written out as conditions.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowork.functions.text import col, trim_all

# What each tool does with which formats. (tool, support, needs authorisation or the advanced part, formats)
CAPABILITIES = (
    ("pdfKit", "primary", False, "pdf"),
    ("vision", "primary", False, "pdf png jpg jpeg tiff tif heic heif"),
    ("speech", "primary", True, "mp3 m4a wav aiff opus"),
    ("imageIO", "metadataOnly", False, "png jpg jpeg gif tiff tif webp bmp heic heif"),
    ("avFoundation", "metadataOnly", False, "mp3 m4a wav aiff opus flac aac ogg mp4 m4v mov avi mpeg mpg webm mkv wma wmv"),
    ("office", "primary", False, "docx pptx xlsx doc xls ppt"),
    ("text", "primary", False, "md txt csv"),
    ("html", "primary", False, "html"),
    ("epub", "primary", False, "epub"),
    ("ai", "fallback", True, "pdf png jpg jpeg tif tiff webp"),
)
ACCEPTED = tuple("pdf html txt csv png jpg jpeg gif tiff docx pptx xlsx doc xls ppt epub mp3 m4a wav aiff opus".split())
MEDIA = tuple("mp3 m4a wav aiff opus flac aac ogg mp4 m4v mov avi mpeg mpg webm mkv wma wmv".split())
STRUCTURED = {**dict.fromkeys("docx doc".split(), "nativeOffice"), **dict.fromkeys("txt md csv".split(), "nativeText"), **dict.fromkeys("pptx xlsx xls ppt asciidoc epub json xml zip webvtt".split())}
IMAGES = tuple("png jpg jpeg tiff tif heic heif webp bmp gif".split())
LATIN = tuple("en fr de es it pt nl sv da nb fi pl cs tr vi id ms ro hu hr ca".split())
WEAK_LANGUAGES = tuple("ja zh ko ar he hi th".split())
DEFAULT_EXCLUDES = "*.md *.markdown *.json *.tmp *.download *.part *.crdownload ~$*"
#: stage: (progress without a fraction, band)
STAGES = {
    "queued": (0.0, 0.0, 0.0), "copying": (0.06, 0.01, 0.06), "analysing": (0.12, 0.06, 0.12), "extracting": (0.20, 0.12, 0.20), "processing": (0.55, 0.20, 0.88),
    "postProcessing": (0.88, 0.88, 0.96), "complete": (1.0, 1.0, 1.0), "failed": (1.0, 1.0, 1.0), "cancelled": (1.0, 1.0, 1.0),
}
ERROR_CODES = {
    "inaccessible": "file.access", "passwordRequired": "file.password", "cancelled": "job.cancelled", "noProgress": "job.no-progress", "memoryPressure": "system.memory-pressure",
    "fileTooLarge": "file.too-large", "sourceUnavailable": "file.unavailable", "unsupportedDevice": "device.unsupported-conversion", "modelUnavailable": "model.unavailable",
    "downloadFailed": "model.download-failed", "upgradeRequired": "entitlement.upgrade-required", "engineFailed": "engine.failed",
}
DEFAULT_ERROR = "conversion.failed"
SCAN_PAGES, TEXT_PAGES, PAGE_SIDE, PAGE_AREA, IMAGE_PIXELS, RENDER_SIDE, RENDER_PIXELS = 80, 1000, 14_400.0, 50_000_000.0, 40_000_000, 4096, 16_000_000
BUDGET_SCORE = 0.82
REDACTED_SUFFIXES = "pdf|docx|doc|pptx|ppt|xlsx|xls|html|htm|md|txt|png|jpg|jpeg|gif|tiff|csv|json|xml|zip|mp3|m4a|wav|aiff|ogg"
REDACTED_TOOLS = "pythonBridge|python|docling|pdfium|pythonkit|pymupdf|markitdown"


def capability_table(spark: SparkSession) -> DataFrame:
    """(tool, support, guarded, ext): the matrix as rows."""
    rows = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(s).alias("support"), F.lit(g).alias("guarded"), F.split(F.lit(f), " ").alias("exts")) for t, s, g, f in CAPABILITIES))
    return spark.range(0, 1, 1, 1).select(F.inline(rows)).select("tool", "support", "guarded", F.explode("exts").alias("ext"))


def capabilities(df: DataFrame) -> DataFrame:
    """The rows of `df` (with ext) once for each tool that handles their format."""
    return df.withColumn("ext", F.lower("ext")).join(F.broadcast(capability_table(df.sparkSession)), "ext")


def accepts(df: DataFrame) -> DataFrame:
    """The rows whose format is on the accepted list and handled by a tool."""
    handled = capability_table(df.sparkSession).filter(F.col("ext").isin(*ACCEPTED)).select(F.col("ext").alias("_ext")).distinct()
    return df.join(F.broadcast(handled), F.lower("ext") == F.col("_ext"), "left_semi")


def classify_content(ext: Column | str) -> Column:
    """struct(kind, capability, pathway) of a format; pdf and pictures are decided by their content; null if unknown."""
    x = F.lower(col(ext))

    def route(kind: str, capability, pathway) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(capability).cast("string").alias("capability"), F.lit(pathway).cast("string").alias("pathway"))

    out = F.when(x.isin(*MEDIA), route("audioVideo", "native", "metadata")).when(x == "html", route("structuredDocument", "native", "nativeHTML"))
    for pathway in ("nativeOffice", "nativeText", None):
        own = [k for k, v in STRUCTURED.items() if v == pathway]
        out = out.when(x.isin(*own), route("structuredDocument", "native" if pathway else "enhanced", pathway or "enhanced"))
    return out.when(x == "pdf", route("pdf", None, None)).when(x.isin(*IMAGES), route("image", None, None))


def route_pdf(recommended: Column, advanced: Column, ai: Column) -> Column:
    """struct(kind, capability, pathway) of a pdf from its recommendation and what the installation has."""

    def route(kind, capability, pathway) -> Column:
        return F.struct(F.lit(kind).alias("kind"), capability.alias("capability"), pathway.alias("pathway"))

    enhanced = route("digitalDocument", F.when(advanced, "enhanced").otherwise("native"), F.when(advanced, "enhanced").otherwise("pdfKit"))
    scanned = route("scannedDocument", F.when(ai, "ai").otherwise("native"), F.when(ai, "ai").otherwise("visionOCR"))
    return F.when(recommended == "pdfKit", route("digitalDocument", F.lit("native"), F.lit("pdfKit"))).when(recommended == "enhanced", enhanced).when(recommended == "visionOCR", scanned)


def route_image(frames: Column, words: Column, ai: Column) -> Column:
    """Several frames or ten words make a scanned document; other pictures give metadata only."""
    scanned = (frames > 1) | (words >= 10)
    return F.struct(
        F.when(scanned, "scannedDocument").otherwise("photoOrArtwork").alias("kind"),
        F.when(scanned & ai, "ai").otherwise("native").alias("capability"),
        F.when(scanned, F.when(ai, "ai").otherwise("visionOCR")).otherwise("metadata").alias("pathway"),
    )


def likely_scanned(chars: Column, lines: Column, confidence: Column, pages_with_text: Column, available: Column) -> Column:
    return (chars < 80) & available & (pages_with_text > 0) & (lines > 8) & (confidence > 0.35)


def recommend(e: Column) -> Column:
    """struct(pathway, confidence, bucket, reasons) from an evidence struct, by the first rule that fits."""
    scanned = likely_scanned(e["avg_chars"], e["seen_lines"], e["seen_confidence"], e["pages_with_text"], e["vision"])
    packed = (e["avg_lines"] > 45) & (e["short_ratio"] > 0.45)
    columns, dense = e["columns"] > 1, e["dense_pages"] > 0
    complex_layout = e["table_like"] | e["rtl"] | columns | dense | packed
    figure = (e["sampled_pages"] > 0) & (e["avg_lines"] <= 14) & ((e["numeric_ratio"] >= 0.35) | e["axis"])
    normalise = (e["rotated"] > 0) | (e["oversized"] > 0) | (e["rectangles"] > 0) | (e["skew"] >= 2)
    why_scanned = F.array_compact(F.array(F.lit("low native text"), F.lit("image text detected"), F.when(normalise, "image normalization available")))
    why_complex = F.array_compact(
        F.array(F.when(e["table_like"], "table-like text"), F.when(e["rtl"], "right-to-left text"), F.when(columns, "multi-column layout"), F.when(dense, "dense text layout"), F.when(packed, "dense multi-column layout"))
    )

    def answer(pathway: str, confidence: float, bucket: str, reasons: Column) -> Column:
        return F.struct(F.lit(pathway).alias("pathway"), F.lit(confidence).alias("confidence"), F.lit(bucket).alias("bucket"), reasons.alias("reasons"))

    return (
        F.when(scanned, answer("visionOCR", 0.86, "scannedOrUnknown", why_scanned))
        .when(complex_layout, answer("enhanced", 0.78, "digitalComplex", why_complex))
        .when(figure, answer("pdfKit", 0.74, "native", F.array(F.lit("short figure text"))))
        .otherwise(answer("pdfKit", 0.70, "native", F.array(F.lit("digital text"))))
    )


def engine(e: Column) -> Column:
    """`model` for clean print in Latin script or simplified Chinese, else `vision`."""
    lang = F.lower(e["language"])
    friendly = ~lang.startswith("zh-hant") & (lang.startswith("zh-hans") | (lang == "zh") | F.split(lang, "-")[0].isin(*LATIN))
    fits = e["vision"] & (e["seen_confidence"] >= 0.6) & ~e["rtl"] & ~e["mixed"] & (e["columns"] < 3) & friendly
    return F.when(fits, "model").otherwise("vision")


def hints(e: Column) -> Column:
    """Up to six preprocessing hints in fixed order."""
    camera = (e["rectangles"] > 0) | (e["skew"] >= 2)
    return F.array_compact(
        F.array(
            F.when(e["oversized"] > 0, "bounded image render"), F.when(e["rotated"] > 0, "normalize page rotation"), F.when(camera, "crop or deskew document image"),
            F.when(e["columns"] > 1, "preserve multi-column layout"), F.when(e["dense_pages"] > 0, "inspect dense text layout"), F.when(e["mixed"], "preserve mixed-language text"),
        )
    )


def bucket_corpus(ext: Column, e: Column) -> Column:
    """The batch variant of the routing rules: format classes first, other thresholds, and a rule for unknown pages.

    Returns struct(bucket, recommendation, confidence).
    """
    x = F.lower(ext)

    def answer(bucket: str, recommendation: str, confidence) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), F.lit(recommendation).alias("recommendation"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    read = (e["seen_lines"] > 3) & (e["seen_confidence"] > 0.25)
    table_like = e["table_lines"] >= F.greatest(F.lit(2), e["sampled_pages"])
    pdf = (
        F.when((e["avg_chars"] < 80) & (e["seen_lines"] > 8) & (e["seen_confidence"] > 0.35), answer("scannedOrUnknown", "imageText", 0.86))
        .when((e["avg_chars"] < 80) & (e["seen_lines"] == 0), answer("scannedOrUnknown", "imageText", 0.58))
        .when(table_like | e["rtl"] | ((e["avg_lines"] > 45) & (e["short_ratio"] > 0.45)), answer("digitalComplex", "enhanced", 0.78))
        .otherwise(answer("native", "native", 0.70))
    )
    return (
        F.when(x == "pdf", pdf)
        .when(x.isin("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp", "gif"), answer("scannedOrUnknown", "imageText", F.when(read, 0.82).otherwise(0.58)))
        .when(x.isin("mp3", "m4a", "wav", "aiff", "opus", "flac", "aac", "mp4", "mov", "avi"), answer("native", "native", 0.72))
        .when(x.isin("csv", "json", "xml", "html", "htm", "epub", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "asciidoc", "md", "vtt"), answer("digitalComplex", "enhanced", 0.66))
        .otherwise(answer("scannedOrUnknown", "imageText", 0.40))
    )


def needs_secondary(pages: Column, scanned: Column, special: Column, score: Column) -> Column:
    """Whether a second engine is worth its cost: few enough pages, and a scan, special text or a low first score."""
    return (pages <= SCAN_PAGES) & (scanned | special | (score < BUDGET_SCORE))


def advise(bucket: Column, confidence: Column, language: Column) -> Column:
    """struct(advice, score, language_warning)"""
    advice = F.when(bucket == "native", "basic").when(bucket == "digitalComplex", "ai_recommended").otherwise("ai_required")
    weak = F.split(F.lower(F.coalesce(language, F.lit(""))), "-")[0].isin(*WEAK_LANGUAGES)
    return F.struct(advice.alias("advice"), F.floor(confidence * 100).cast("long").alias("score"), (weak & (advice != "basic")).alias("language_warning"))


def enforce_limits(pages: Column, scan: Column, width: Column, height: Column) -> Column:
    """ok, tooManyPages, invalidPageBounds or pageTooLarge; sides in points."""
    most = F.when(scan, SCAN_PAGES).otherwise(TEXT_PAGES)
    bad = width.isNull() | height.isNull() | F.isnan(width) | F.isnan(height) | (width <= 0) | (height <= 0)
    large = (width > PAGE_SIDE) | (height > PAGE_SIDE) | (width * height > PAGE_AREA)
    return F.when(pages > most, "tooManyPages").when(bad, "invalidPageBounds").when(large, "pageTooLarge").otherwise("ok")


def render_size(width: Column, height: Column, dpi: float = 150.0) -> Column:
    """struct(width, height) in pixels, clamped to the longest side and then to the area."""

    def whole(x: Column) -> Column:
        return F.greatest(F.floor(x), F.lit(1)).cast("long")

    w, h = whole(width * (dpi / 72)), whole(height * (dpi / 72))
    ratio = F.least(F.lit(1.0), RENDER_SIDE / F.greatest(w, h))
    w, h = F.when(ratio < 1, whole(w * ratio)).otherwise(w), F.when(ratio < 1, whole(h * ratio)).otherwise(h)
    area = F.sqrt(RENDER_PIXELS / (w * h))
    return F.struct(F.when(area < 1, whole(w * area)).otherwise(w).alias("width"), F.when(area < 1, whole(h * area)).otherwise(h).alias("height"))


def match_rules(name: Column | str, include: str = "", exclude: str = DEFAULT_EXCLUDES) -> Column:
    """Names that an include pattern matches (all, without patterns) and no exclude pattern does.

    Patterns are divided by commas and white space, and match as a glob over the whole name or as a part of it.
    """
    x = F.lower(col(name))

    def any_of(patterns: str, default: bool) -> Column:
        own = [p.lower() for p in patterns.replace(",", " ").split()]
        if not own:
            return F.lit(default)
        globs = "|".join(f"^{fnmatch.translate(p)}".replace(r"\z", r"\Z") for p in own)  # a name is matched once
        out = F.regexp_like(x, F.lit(globs))
        for p in own:
            out = out | F.contains(x, F.lit(p))
        return out

    return any_of(include, True) & ~any_of(exclude, False)


def normalise_status(status: Column, error: Column, blocked_reason: Column) -> Column:
    message = F.lower(F.concat_ws(" ", error, blocked_reason))

    def has(*terms: str) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(message, F.lit(t))
        return out

    failed = (error.isNotNull()) & (error != "")
    return (
        F.when((status != "") & ~status.isin("failed", "error"), status)
        .when(has("password") & has("protected", "required", "encrypted"), "expected_blocked")
        .when(has("metal device", "no metal", "device compatibility", "couldn't run on this mac", "graphics processor"), "environment_blocked")
        .when(failed, "failed")
        .otherwise("scored")
    )


def error_code(df: DataFrame, column: str = "error") -> DataFrame:
    """The frame with error_code: the stable code of a known error, the default for others, null without an error."""
    known = F.create_map(*(F.lit(x) for pair in ERROR_CODES.items() for x in pair))
    return df.withColumn("error_code", F.when(F.col(column).isNotNull(), F.coalesce(F.element_at(known, F.col(column)), F.lit(DEFAULT_ERROR))))


def redact(x: Column | str, home: str = "/Users/me") -> Column:
    """Home folders, paths, file names and the names of tools are replaced."""
    text = F.replace(col(x), F.lit(home), F.lit("~"))
    text = F.regexp_replace(text, r"(?i)(?:~|/Users|/Volumes|/private/var)/[^\s,;:)\"]+", "[redacted path]")
    text = F.regexp_replace(text, rf"(?i)\b[^\s/]+\.({REDACTED_SUFFIXES})\b", "[redacted file]")
    return F.regexp_replace(text, rf"(?i)\b({REDACTED_TOOLS})\b", "conversion runtime")


def search_history(df: DataFrame, query: str, columns=("source_name", "ext", "title", "format", "provenance"), created: str = "created_at", body: str = "markdown") -> DataFrame:
    """Records that hold the query, in any case, in a name, the date or the text; a blank query keeps all."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    hay = F.lower(F.concat_ws(" ", *(col(c) for c in columns), F.date_format(created, "yyyy-MM-dd"), col(body)))
    return df.filter(F.contains(hay, F.lit(wanted)))


def validate_requests(version: Column, input_file: Column, output_mode: Column, use_ai: Column, ai_engine: Column) -> Column:
    """accepted or inputRejected: known version and mode, a safe relative file name, an engine only with AI."""
    safe = (input_file != "") & ~input_file.startswith("/") & ~F.contains(input_file, F.lit("/")) & ~input_file.isin(".", "..") & ~F.contains(input_file, F.lit("\\"))
    mode = output_mode.isin("markdown", "markdownWithFrontmatter", "json")
    fits = version.isin(1, 2) & safe & mode & (ai_engine.isNull() | use_ai)
    return F.when(F.coalesce(fits, F.lit(False)), "accepted").otherwise("inputRejected")


def degenerate(text: Column | str) -> Column:
    """Reasons to reject a page's output: empty, too many words or bytes, a line or a 12-word phrase six times."""
    from foliowork.functions.text import let, lines, tokens

    x = col(text)

    def step(acc: Column, t: Column) -> Column:
        run = F.when(t == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    def most(values: Column, empty) -> Column:
        counted = lambda own: F.aggregate(F.sort_array(own), F.struct(empty.alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")), step)["most"]
        return let(values, lambda own: F.when(F.size(own) - F.size(F.array_distinct(own)) < 5, 0).otherwise(counted(own)))

    own = F.filter(F.transform(lines(x), trim_all), lambda t: t != "")
    words = tokens(x)
    # Windows of twelve words by the hashes of their words' hashes: words are hashed once, and windows are numbers.
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashed, lambda w: F.when(F.size(w) >= 17, F.transform(F.sequence(F.lit(1), F.size(w) - 11), lambda i: F.xxhash64(F.slice(w, i, F.lit(12))))).otherwise(F.array().cast("array<long>")))
    return F.array_compact(
        F.array(
            F.when(trim_all(x) == "", "empty"), F.when(F.size(words) > 3500, "too many words"), F.when(F.octet_length(x) > 120_000, "too many bytes"),
            F.when(most(own, F.lit("")) >= 6, "repeated line"), F.when(most(grams, F.lit(0).cast("long")) >= 6, "repeated phrase"),
        )
    )


def storage_kind(path: Column | str) -> Column:
    x = col(path)
    return (
        F.when(F.contains(x, F.lit("/Mobile Documents/")), "iCloudDrive")
        .when(F.contains(x, F.lit("/Library/CloudStorage/")), "fileProvider")
        .when(x.startswith("/Volumes/"), "externalVolume")
        .when(x.startswith("/Network/") | x.startswith("/net/"), "networkVolume")
        .otherwise("local")
    )


def progress(stage: Column, fraction: Column) -> Column:
    """Progress of a job: fixed for a stage, or along its band where a finite fraction is known and the stage runs."""
    clean = F.when(fraction.isNotNull() & ~F.isnan(fraction) & (F.abs(fraction) != float("inf")), F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)))
    out = F.lit(None).cast("double")
    for name, (fixed, low, high) in STAGES.items():
        runs = name not in ("queued", "complete", "failed", "cancelled")
        own = F.coalesce(low + (high - low) * clean, F.lit(fixed)) if runs else F.lit(fixed)
        out = F.when(stage == name, own).otherwise(out)
    return out


def heading_confidence(text: Column | str, nouns: tuple[str, ...], verbs: tuple[str, ...]) -> Column:
    """struct(confidence, level) of a line as a heading; nouns and verbs come from small lexicons of endings and words."""
    from foliowork.functions.text import let

    t = trim_all(col(text))
    words = F.regexp_replace(F.lower(t), r"[^\p{L}\s]+", "")
    has_verb = F.regexp_like(words, F.lit(rf"(?<!\S)(?:{'|'.join(verbs)})(?!\S)"))
    has_noun = F.regexp_like(words, F.lit(rf"(?:{'|'.join(nouns)})(?!\S)"))
    n = F.length(t)
    kind = F.when(has_verb, -0.3).when((n < 60) & has_noun, 0.3).otherwise(0.0)
    raw = F.lit(0.5) + kind - F.when(n > 100, 0.2).otherwise(0.0)
    raw = raw - F.when(F.regexp_like(t, F.lit("[.,]$")), 0.2).otherwise(0.0) + F.when(F.regexp_like(t, F.lit(r"^\p{Lu}")), 0.1).otherwise(0.0)

    def of(c: Column) -> Column:
        level = F.when(t == "", 0).when((c > 0.7) & (n < 40), 1).when((c > 0.5) & (n < 80), 2).otherwise(3)
        return F.struct(c.alias("confidence"), level.alias("level"))

    return let(F.when(t == "", 0.0).otherwise(F.least(F.greatest(F.round(raw, 6), F.lit(0.0)), F.lit(1.0))), of)
