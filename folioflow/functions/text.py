"""Text functions over columns: everything stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sites that count as academic, and publishers that count as reputable.
ACADEMIC_DOMAINS = (
    "arxiv.org", "science.org", "nature.com", "springer.com", "ieee.org", "ieeexplore.ieee.org", "acm.org",
    "dl.acm.org", "sciencedirect.com", "wiley.com", "onlinelibrary.wiley.com", "plos.org", "cell.com",
    "pnas.org", "oup.com", "academic.oup.com", "tandfonline.com", "mdpi.com", "frontiersin.org",
    "biorxiv.org", "medrxiv.org", "pubmed.ncbi.nlm.nih.gov", "researchgate.net",
)
REPUTABLE_PUBLISHERS = (
    "nature.com", "science.org", "sciencedirect.com", "ieeexplore.ieee.org", "pnas.org", "nejm.org",
    "thelancet.com", "cell.com", "jamanetwork.com", "arxiv.org", "springer.com", "wiley.com",
)

# Phrases that mark boilerplate chunks.
BOILERPLATE = (
    "competing interests",
    "acknowledgements",
    "author contributions",
    "check for updates",
    "nature portfolio reporting summaries",
    "additional references",
    "data availability",
    "code availability",
    "peer review information",
    "publisher's note",
    "https://doi.org",
    "should be addressed to",
    "open access",
    "creative commons",
    "reporting summary",
)
# Patterns of the chunk filter, headings and captions.
DOI_ONLY = r"^(https?://)?(www\.)?doi\.org/[^\s]+$|^10\.\d{4,9}/[-._;()/:A-Z0-9]+$"
PUBLISHED = r"published\s*[:\s]\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[a-z]+\s+\d{4})"
# One name is enough for the marks of authors: further ones up to the next comma or
# full stop are part of what follows it.
AUTHOR_MARK = r"[A-Z][a-z]+[^,.]+([,.]\s*)?(\$?\s?\^\{\d+\}\s?\$?|[¹²³⁴⁵⁶⁷⁸⁹⁰]+)"
MARK = r"\^\{\d+\}|[¹²³⁴⁵⁶⁷⁸⁹⁰]"
MARK_STARTS = ("^{", *"¹²³⁴⁵⁶⁷⁸⁹⁰")  # found faster, for texts that have none
# From the first to the last character that is no white space: a hundred or more.
LONG_ENOUGH = r"(?s)\S.{98,}\S"
DOI_START = r"^\s*((https?://)?(www\.)?doi\.org/|10\.)"
METHODS = (
    r"methods|materials?\s+and\s+methods|methods?\s+and\s+materials?|experimental|experimental\s+section|"
    r"experimental\s+methods?|materials?|methodology|procedures?|computational\s+methods?|"
    r"experimental\s+procedures?|synthesis|characterization"
)
REFERENCES = r"references|bibliography|works\s+cited|literature\s+cited"
CAPTION = r"^(?i:Figure|Fig\.)\s*\d+\s*[.|:]"
NUMBERED_CAPTION = r"(?i)^(Figure|Fig\.)\s*\d+\b"
FIRST_CAPTION = r"(?i)^(Figure|Fig\.)\s*1\b"
PANEL = r"^(\([A-Z](\s*([-–]|and|to)\s*[A-Z])?\)\s|[a-z],\s)"
CITED = r"\[(\d+(?:,\s*\d+)*)\]"

_EDGES = r"^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end (trim() knows spaces only)."""
    return F.regexp_replace(c, _EDGES, "")


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def normal_lines(c: Column) -> Column:
    """Trimmed, with LF line ends, single blanks, and no blank around a line end."""
    c = F.replace(trimmed(c), F.lit("\r\n"), F.lit("\n"))
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")
    return F.replace(F.replace(c, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))


def with_value(c: Column, made) -> Column:
    """``made(c)``, for which ``c`` is computed once, however often it stands there."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def is_uninformative(content: Column) -> Column:
    """Whether a chunk is too short, bare of letters and digits, a DOI, boilerplate,
    a publication date or a list of marked authors.

    White space at the ends counts for the length and the DOI only. What looks for
    authors may go back over all that follows a name, so it sees marked texts alone.
    """
    marks = F.size(F.regexp_extract_all(content, F.lit(AUTHOR_MARK), F.lit(0)))
    return (
        ~content.rlike(LONG_ENOUGH)
        | ~content.rlike("[a-zA-Z0-9]")
        | (content.rlike(f"(?i){DOI_START}") & trimmed(content).rlike(f"(?i){DOI_ONLY}"))
        | with_value(F.lower(content), lambda t: contains_any(t, BOILERPLATE))
        | content.rlike(f"(?i){PUBLISHED}")
        | (contains_any(content, MARK_STARTS) & content.rlike(MARK) & (marks >= 2))
    )


def is_methods_heading(c: Column) -> Column:
    return trimmed(c).rlike(f"(?i)^(?:{METHODS})$")


def is_references_heading(c: Column) -> Column:
    return trimmed(c).rlike(f"(?i)^(?:{REFERENCES})$")


def is_caption(c: Column) -> Column:
    return trimmed(c).rlike(CAPTION)


def is_numbered_caption(c: Column) -> Column:
    """A caption of a figure, whatever follows its number."""
    return trimmed(c).rlike(NUMBERED_CAPTION)


def is_first_caption(c: Column) -> Column:
    return trimmed(c).rlike(FIRST_CAPTION)


def is_panel(c: Column) -> Column:
    return trimmed(c).rlike(PANEL)


def is_academic(domain: Column, url: Column) -> Column:
    return contains_any(domain, ACADEMIC_DOMAINS) | contains_any(url, ACADEMIC_DOMAINS)


def is_reputable(url: Column) -> Column:
    return contains_any(F.lower(url), REPUTABLE_PUBLISHERS)


def loose_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def same_title(a: Column, b: Column) -> Column:
    x, y = loose_title(a), loose_title(b)
    return (F.length(x) >= 10) & (F.length(y) >= 10) & (x == y)


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_"), r"\.{2,}", ".")


def shortened(c: Column, n: int, mark: str = "…") -> Column:
    """The first n characters, with a mark where more followed; null is empty."""
    return F.coalesce(F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c), F.lit(""))


def author_line(names: Column, most: int = 3) -> Column:
    """Names joined by commas, those after the third as "et al."; null without names."""
    some = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(some, F.lit(" et al."))).when(F.size(names) > 0, some)


def citation(authors: Column, title: Column, venue: Column, year: Column, doi: Column) -> Column:
    """The parts that are not empty, joined by full stops."""
    link = F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi))
    parts = F.array(author_line(F.filter(authors, lambda a: a != "")), title, venue, F.nullif(year.cast("string"), F.lit("0")), link)
    return F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ". "), F.lit("."))


def encoded(c: Column) -> Column:
    """Percent-encoded as a URL component: form encoding with the signs undone that
    a component keeps."""
    c = F.url_encode(c)
    for coded, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(coded), F.lit(sign))
    return c


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def paper_url(arxiv: Column, doi: Column, pubmed: Column, url: Column) -> Column:
    return (
        F.when(_has(arxiv), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
        .when(_has(doi), F.concat(F.lit("https://doi.org/"), encoded(doi)))
        .when(_has(pubmed), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pubmed))
        .otherwise(F.coalesce(url, F.lit("")))
    )


def library_url(arxiv: Column, doi: Column, url: Column) -> Column:
    """As paper_url, but a DOI goes before an arXiv number."""
    return (
        F.when(_has(doi), F.concat(F.lit("https://doi.org/"), doi))
        .when(_has(arxiv), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
        .otherwise(F.coalesce(url, F.lit("")))
    )


def stored_url(doi: Column, graph_id: Column) -> Column:
    return (
        F.when(_has(doi), F.concat(F.lit("https://doi.org/"), doi))
        .when(_has(graph_id), F.concat(F.lit("https://www.semanticscholar.org/paper/"), graph_id))
        .otherwise("")
    )


def domain(url: Column) -> Column:
    """Host without a leading www.; empty for what is no URL."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), F.lit(""))


def short_domain(host: Column) -> Column:
    return F.array_join(F.slice(F.split(host, r"\."), 1, 2), ".")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(url, r".+//|www.|\..+", "")


def cited_numbers(text: Column, sources: Column) -> Column:
    """Distinct source numbers that [n] and [n, m] marks name, in range and ascending."""
    marks = F.regexp_extract_all(text, F.lit(CITED), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, ","))), lambda n: F.try_to_number(F.trim(n), F.lit("9999999999")).cast("long"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, sources))))


def renumbering(cited: Column) -> Column:
    """Map from each cited number to its place among the cited ones."""
    return F.map_from_entries(F.transform(cited, lambda n, i: F.struct(n, (i + 1).cast("long"))))


def renumbered(text: Column, numbers: Column) -> Column:
    """``text`` with the numbers of its marks replaced by a map; others stay."""
    gaps = F.split(text, CITED, -1)
    one = lambda n: F.coalesce(F.try_element_at(numbers, F.trim(n).cast("long")).cast("string"), F.trim(n))
    marks = F.transform(
        F.regexp_extract_all(text, F.lit(CITED), F.lit(1)),
        lambda m: F.concat(F.lit("["), F.array_join(F.transform(F.split(m, ","), one), ","), F.lit("]")),
    )
    ends = F.concat(marks, F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, ends, lambda g, m: F.concat(g, m)), "")


def closed_thinking(c: Column) -> Column:
    """An answer whose thinking is still open, closed for display."""
    return F.when(c.contains("<think>") & ~c.contains("</think>"), F.concat(c, F.lit("</think> <a> </a>"))).otherwise(c)


def math_tags(c: Column) -> Column:
    """Formulas between $$ signs, then those between single ones on a line, as tags that
    hold them in Base64 (of UTF-8), so that no Markdown rule reads them."""

    def tagged(c, pattern, name, keep_blank):
        gaps = F.split(c, pattern, -1)
        inner = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        said = lambda m: F.concat(F.lit(f'<{name} data-latex="'), F.base64(F.encode(trimmed(m), "UTF-8")), F.lit('">.</' + name + ">"))
        tags = F.transform(inner, lambda m: F.when(trimmed(m) == "", F.concat(F.lit("$"), m, F.lit("$"))).otherwise(said(m)) if keep_blank else said(m))
        return F.array_join(F.zip_with(gaps, F.concat(tags, F.array(F.lit(""))), lambda g, t: F.concat(g, t)), "")

    return tagged(tagged(c, r"\$\$([\s\S]+?)\$\$", "mathblock", False), r"(?<!\$|\\)\$([^\n$]+?)\$(?!\$)", "mathinline", True)


def numbered_sources(titles: Column, scores: Column, contents: Column) -> Column:
    """One line for each source: its number, title, score with three digits where it
    has one, and content."""
    rows = F.arrays_zip(titles.alias("t"), scores.alias("s"), contents.alias("c"))
    score = lambda s: F.coalesce(F.concat(F.lit(" [score: "), F.format_string("%.3f", s), F.lit("]")), F.lit(""))
    return F.array_join(F.transform(rows, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["t"], F.when(r["s"].isNull(), "").otherwise(score(r["s"])), F.lit(" "), r["c"])), "\n")


def json_list(c: Column) -> Column:
    """The numbers of a JSON list, without the fences that may stand around it; null
    for what is no list."""
    bare = trimmed(F.regexp_replace(c, "(?i)```json|```", ""))
    return F.when(bare.startswith("["), F.from_json(F.when(F.try_parse_json(bare).isNotNull(), bare), "array<long>"))


def settings_key(*settings: Column) -> Column:
    """Settings in their order as JSON text, those that are null left out."""
    return F.to_json(F.struct(*settings), {"ignoreNullFields": "true"})


# Parts of names that tell what a model is for.
EMBEDDING_HINTS = ("embedding", "embed", "vector", "text-embed")
OCR_HINTS = ("ocr", "vision", "paddle")


def capabilities(name: Column, families: Column, chat: Column | None = None, embedding: Column | None = None, ocr: Column | None = None) -> Column:
    """struct(chat, embedding, ocr) of a model by its name, its families and what is
    configured (true where it is)."""
    names = F.transform(F.concat(F.array(F.coalesce(name, F.lit(""))), F.coalesce(families, F.array().cast("array<string>"))), lambda x: F.lower(F.coalesce(x, F.lit(""))))
    hinted = lambda hints: F.exists(names, lambda x: sum((x.contains(h).cast("int") for h in hints), F.lit(0)) > 0)
    is_embedding, is_ocr = hinted(EMBEDDING_HINTS), hinted(OCR_HINTS)
    on = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    return F.struct(
        (on(chat) | (~is_embedding & ~is_ocr)).alias("chat"), (on(embedding) | is_embedding).alias("embedding"), (on(ocr) | is_ocr).alias("ocr")
    )


def output_of(c: Column) -> Column:
    """What stands between the first output tag and the next end tag; empty without."""
    return F.regexp_extract(c, "(?s)<output>(.*?)</output>", 1)


def json_object(c: Column) -> Column:
    """The widest {...} of a text, as JSON text, or null if that is no JSON."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def suggestions(c: Column, most: int = 3) -> Column:
    """The first lines that are neither empty nor list items."""
    lines = F.transform(F.split(c, "\n"), trimmed)
    return F.slice(F.filter(lines, lambda s: (F.length(s) > 0) & ~s.startswith("-") & ~s.rlike(r"^\d\.")), 1, most)


def change_counts(short: Column, names: Column) -> Column:
    """struct of files, added and deleted lines of a change summary, and added and
    deleted files of a list of names."""
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(short, p, 1), F.lit("")).cast("int"), F.lit(0))
    lines = F.split(names, "\n")
    count = lambda k: F.size(F.filter(lines, lambda x: x.startswith(k)))
    return F.struct(
        number(r"(\d+)\s+file").alias("files"),
        number(r"(\d+)\s+insertion").alias("lines_added"),
        number(r"(\d+)\s+deletion").alias("lines_deleted"),
        count("A\t").alias("files_added"),
        count("D\t").alias("files_deleted"),
    )


def last_segment(path: Column) -> Column:
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), path)


def sidecar_path(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"(?i)\.pdf$", ""), F.lit(".ocr.json"))


def model_family(name: Column) -> Column:
    """Family of a model by the first part of its name that is known."""
    low = F.lower(name)
    # Parts of names in order of precedence.
    out = F.when(low.contains("gpt-os"), "GPT-OSS").when(low.contains("gpt") | low.rlike("^o[134]"), "GPT")
    for part, family in (
        ("claude", "Claude"), ("embed", "Embeddings"), ("llama", "Llama"), ("deepseek", "DeepSeek"), ("r1", "DeepSeek"),
        ("qwen", "Qwen"), ("gemma", "Gemma"), ("mistral", "Mistral"), ("phi", "Phi"), ("granite", "Granite"),
    ):
        out = out.when(low.contains(part), family)
    return out.otherwise("Other")


def section_label(kind: Column, n: Column) -> Column:
    number = n.cast("string")
    out = F.when((kind == "abstract") & (n == 1), F.lit("abstract"))
    for key, name in (("paragraph_title", "text"), ("abstract", "abstract"), ("figure_title", "figure"), ("table", "table"), ("display_formula", "formula")):
        out = out.when(kind == key, F.concat(F.lit(name + " "), number))
    return out.otherwise(F.concat(kind, F.lit(" "), number))


def chunk_title(kind: Column, content: Column) -> Column:
    """struct(title, body) of a chunk: a text chunk's heading is its first line."""
    at = F.instr(content, "\n")
    own = F.struct(trimmed(F.substring(content, F.lit(1), at - 1)).alias("title"), trimmed(F.substring(content, at + 1, F.length(content))).alias("body"))
    plain = lambda t: F.struct(t.alias("title"), content.alias("body"))
    out = F.when((kind == "paragraph_title") & (at > 1), own).when(kind == "paragraph_title", plain(F.lit("Text")))
    for key, name in (("abstract", "Abstract"), ("figure_title", "Figure Caption"), ("table", "Table"), ("display_formula", "Formula")):
        out = out.when(kind == key, plain(F.lit(name)))
    return out.otherwise(plain(F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))))


def query_key(c: Column) -> Column:
    return F.lower(trimmed(c))
