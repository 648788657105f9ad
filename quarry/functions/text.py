"""Scalar functions over text as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that decide results.
SPACE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
CJK_TOKEN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
CJK_COUNT = r"\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}"
CJK_LANGUAGE = r"\x{4E00}-\x{9FFF}"
CJK_QUERY = r"\x{3400}-\x{9FFF}"
FOREIGN_SCRIPT = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
SENTENCE_END = "。！？!?；;…\n"
CLAUSE_END = "，,、）)】》」』：:"
CLIP_END = "。！？!?；;\n"
INTERROGATIVE = "[?？]|多少|是什么|什么是|为什么|如何|怎么|怎样|哪个|哪些|哪一|是否|能否|可以吗|吗|呢|分别|区别|差别"
BIBLIOGRAPHIC = r"(?i)(参考文献|引用|出处|作者|课题组|发表|期刊|会议|哪一年|年份|卷号|\b(?:reference|citation|author|published|journal|conference|volume|doi)\b)"
MULTI_DOCUMENT = r"(?i)(哪些论文|哪几篇|这几篇|多篇(?:论文|文章|文献)|多份文档|各篇|跨文档|文献(?:对比|比较|汇总|综述)|\b(?:which papers|these papers|multiple papers|across papers|multiple documents|across documents|list the papers)\b)"
AUTHOR_COMPARISON = r"(?i)(课题组|研究组|相同作者|同一作者|共同作者|作者重合|\b(?:research group|same authors?|shared authors?|co-?authors?)\b)"
REFERENCE_MARK = r"(?i)(vol\.|pp\.|et al\.|IEEE Trans|arXiv|Proceedings|doi:|\[\d+\])"
REFERENCE_ENTRY = r"(?i)\b(vol\.|no\.|pp\.|doi:|arXiv:)"
GLUED = "[A-Za-z]{20,}"
CITATION = r"\[(\d+)\]"


def sanitize(text: Column) -> Column:
    """Without control characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, CONTROL, "")


def fold(text: Column) -> Column:
    """White space folded to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def text_hash(text: Column) -> Column:
    """sha256 of the folded text; null counts as empty."""
    return F.sha2(fold(F.coalesce(text, F.lit(""))), 256)


def chunk_hash(content: Column, chunker_version: str, model: str, dimensions: int) -> Column:
    """Hash that changes with the folded content, the chunker, the model or its dimensions."""
    return F.sha2(F.concat_ws("\u001f", fold(F.coalesce(content, F.lit(""))), F.lit(chunker_version), F.lit(model), F.lit(str(dimensions))), 256)


def node_id(doc_id: Column, order: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", doc_id.cast("string"), order.cast("string"))), 1, 16)


def tokens(text: Column) -> Column:
    """Runs of CJK characters as all single characters, then all pairs; other letter and digit runs in lower case."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[{CJK_TOKEN}]+|[\p{{L}}\p{{N}}&&[^{CJK_TOKEN}]]+"), F.lit(0))

    def grams(run: Column, size: int) -> Column:
        n = F.char_length(run)
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    cjk = lambda run: F.concat(grams(run, 1), grams(run, 2))
    has_cjk = F.coalesce(text, F.lit("")).rlike(f"[{CJK_TOKEN}]")
    plain = F.transform(runs, lambda run: F.lower(run))
    mixed = F.flatten(F.transform(runs, lambda run: F.when(run.rlike(f"^[{CJK_TOKEN}]"), cjk(run)).otherwise(F.array(F.lower(run)))))
    return F.when(has_cjk, mixed).otherwise(plain)


def token_count(text: Column) -> Column:
    """Estimate of model tokens: one for each CJK character, one for each four others begun; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    other = F.char_length(F.regexp_replace(text, f"[{CJK_COUNT}]", ""))
    return (F.char_length(text) - other + F.ceil(other / 4)).cast("int")


def language(text: Column) -> Column:
    """zh, mixed or en by the share of CJK characters among the first 4000."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4000)
    n = F.char_length(head)
    share = F.when(n == 0, F.lit(0.0)).otherwise((n - F.char_length(F.regexp_replace(head, f"[{CJK_LANGUAGE}]", ""))) / n)
    return F.when(share > 0.30, "zh").when(share < 0.05, "en").otherwise("mixed")


def mostly_cjk(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(f"[{CJK_QUERY}]"))
    return (cjk >= 8) & (cjk >= F.regexp_count(text, F.lit("[A-Za-z]")) * 0.2)


def mixed_language_term(query: Column) -> Column:
    """Has CJK characters and a Latin word of four letters or more that is not all capitals."""
    words = F.regexp_extract_all(query, F.lit(r"\b[A-Za-z][A-Za-z-]{3,}\b"), F.lit(0))
    return query.rlike(f"[{CJK_QUERY}]") & F.exists(words, lambda w: w != F.upper(w))


def needs_translation(query: Column, target: str = "en") -> Column:
    return F.lit(target == "en") & query.rlike(FOREIGN_SCRIPT)


def translation_guard(query: Column, translated: Column) -> Column:
    """The folded translation without outer quotes; null if it is empty, still foreign or too long."""
    clean = F.regexp_replace(fold(translated), "^[\"'“”]+|[\"'“”]+$", "")
    return F.when((clean != "") & ~clean.rlike(FOREIGN_SCRIPT) & (F.char_length(clean) <= 400) & query.isNotNull(), clean)


def split_keep(text: Column, ends: str = SENTENCE_END) -> Column:
    """Pieces that end with one of ``ends``, and the rest; pieces of white space alone are left out."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+$"), F.lit(0))
    return F.filter(pieces, lambda p: p.rlike(rf"[^\s]") & (strip(p) != ""))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after a sentence's end if one stands in the second half."""
    text = F.coalesce(text, F.lit(""))
    head = F.substring(text, 1, limit)
    kept = F.regexp_extract(head, rf"(?s)^(.*[{CLIP_END}])", 1)
    # the place of the last end, from 0, has to reach half of the limit
    return F.when(F.char_length(text) <= limit, text).when(F.char_length(kept) - 1 >= limit // 2, kept).otherwise(head)


def keyword_salad(text: Column) -> Column:
    """No question word and at least four pieces with Chinese characters."""
    return ~text.rlike(INTERROGATIVE) & (F.regexp_count(text, F.lit(r"\S*[\x{4E00}-\x{9FFF}]\S*")) >= 4)


def rewrite_guard(original: Column, rewritten: Column) -> Column:
    """The rewritten query if it is neither a list of key words nor much longer than the original."""
    good = (strip(rewritten) != "") & ~keyword_salad(rewritten) & (F.char_length(rewritten) <= F.char_length(original) * 4 + 50)
    return F.when(F.coalesce(good, F.lit(False)), rewritten).otherwise(original)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space left out."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")
    n = F.char_length(t)
    return F.array_distinct(F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def citations(text: Column) -> Column:
    """Cited numbers in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int")))


def best_quote(answer: Column, content: Column, window: int = 60) -> Column:
    """The window of the content whose character pairs the answer shares most; the first of equals.

    Windows start every third of their length; without pairs in the answer it is the content's start.
    """
    step = max(window // 3, 1)
    content = F.coalesce(content, F.lit(""))
    grams = bigrams(answer)
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(content) - window, F.lit(0)), F.lit(step))

    def scored(pos: Column) -> Column:
        piece = bigrams(F.substr(content, pos + 1, F.lit(window)))
        score = F.when(F.size(piece) > 0, F.size(F.array_intersect(piece, grams)) / F.size(piece)).otherwise(F.lit(-1.0))
        return F.struct(score.alias("score"), (-pos).alias("back"))

    best = -F.array_max(F.transform(starts, scored))["back"]
    return F.when(F.size(grams) == 0, F.substring(content, 1, window)).otherwise(F.substr(content, F.coalesce(best, F.lit(0)) + 1, F.lit(window)))


def label(title: Column, section: Column, page_start: Column, page_end: Column) -> Column:
    """title · section · pages."""
    pages = F.when(page_start > 0, F.when(page_end > page_start, F.concat(F.lit("p"), page_start, F.lit("-"), page_end)).otherwise(F.concat(F.lit("p"), page_start)))
    return F.concat_ws(" · ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")), pages)


def evidence_key(text: Column) -> Column:
    """Letters and digits alone, in lower case, superscript digits as plain ones."""
    plain = F.translate(F.coalesce(text, F.lit("")), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    return F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]", "")


def is_junk(text: Column) -> Column:
    """Shorter than 40 characters folded, or three marks of a reference or more."""
    t = fold(F.coalesce(text, F.lit("")))
    return (F.char_length(t) < 40) | (F.regexp_count(t, F.lit(REFERENCE_MARK)) >= 3)


def is_reference_entry(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(REFERENCE_ENTRY)) >= 2


def is_glued(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(GLUED)


def furniture_key(text: Column) -> Column:
    """What repeats from page to page: digits as #, no spaces, no outer punctuation."""
    t = F.regexp_replace(F.regexp_replace(text, r"\d+", "#"), SPACE, "")
    return F.lower(F.regexp_replace(t, r"^[-–—|·.]+|[-–—|·.]+$", ""))


def title_of_uri(uri: Column) -> Column:
    """File stem of a path or address without its query."""
    name = F.regexp_extract(F.regexp_replace(uri, r"[?#].*$", ""), r"([^/\\]*)[/\\]?$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def backoff_seconds(attempt: Column) -> Column:
    """5 seconds doubled for each attempt after the first, 300 at most."""
    return F.least(F.lit(5.0) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(300.0))


def minutes(hhmm: Column) -> Column:
    """Minutes of an HH:MM text; null if it is none."""
    good = hhmm.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(good, F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.substring(hhmm, 4, 2).try_cast("int"))


def hhmm(minute: Column) -> Column:
    return F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table: first row as head, short rows filled up; null if every cell is empty."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    clean = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(strip(F.regexp_replace(F.regexp_replace(F.try_element_at(r, i), r"\|", r"\\|"), r"\s*\n\s*", " ")), F.lit(""))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(clean[0]), rule), F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), line))
    some = F.exists(F.flatten(clean), lambda c: c != "")
    return F.when((F.size(rows) > 0) & (width > 0) & some, F.array_join(lines, "\n"))


def markdown_cells(table: Column) -> Column:
    """Cells of a Markdown table, without the rule under its head."""
    lines = F.filter(F.split(table, "\n"), lambda x: x.rlike(r"\S"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\||\|$", ""), r"\|"), lambda c: strip(c)))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-+:?$")))


def highlight_terms(query: Column) -> Column:
    """Latin terms of two letters or more and CJK pairs, longest first."""
    cjk = F.regexp_extract_all(query, F.lit(f"[{CJK_QUERY}]+"), F.lit(0))
    pairs = F.flatten(F.transform(cjk, lambda r: F.when(F.char_length(r) >= 2, F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))))
    terms = F.array_distinct(F.concat(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]{2,}"), F.lit(0)), pairs))
    return F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])


def l2_normalize(vector: Column) -> Column:
    """Unit vector in double precision; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
