"""URLs and HTML, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveloom.functions.text import plain_form, unescaped, untagged

TEST_HOSTS = ("test.", "staging.", "dev.", "preprod.")
NOT_DOCUMENTS = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "mp3", "mp4", "zip", "xml", "json")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def stem_and_extension(url: Column) -> tuple[Column, Column]:
    """Of the last segment."""
    last = F.regexp_extract(path(url), r"([^/]*)/*$", 1)
    ext = F.lower(F.regexp_extract(last, r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(ext != "", F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", "")).otherwise(last), ext


def normal_url(url: Column) -> Column:
    """Without fragment, host in lower case, runs of slashes in the path squeezed."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host(url), F.regexp_replace(path(url), "/+", "/"), query)


def canonical(url: Column) -> Column:
    """A key without scheme, www. and trailing slashes."""
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/+$", ""), query)


def in_domains(url: Column, domains: tuple[str, ...], test_hosts: tuple[str, ...] = TEST_HOSTS) -> Column:
    """The host, less www., is one of the domains or below one, and not a test host."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    found, test = F.lit(False), F.lit(False)
    for d in domains:
        found = found | (h == d) | F.endswith(h, F.lit("." + d))
    for t in test_hosts:
        test = test | F.startswith(h, F.lit(t))
    return found & ~test


def is_document(url: Column, barred: tuple[str, ...] = NOT_DOCUMENTS) -> Column:
    return ~stem_and_extension(url)[1].isin(*barred)


def has_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![\w]){word}(?![\w])")


def document_type(url: Column, anchor: Column, terms: tuple[str, ...], service: tuple[str, ...]) -> Column:
    """`altro` for a homepage or a service page, `programma` where the stem or the anchor has a term, else `comunicato`."""
    stem = plain_form(stem_and_extension(url)[0])
    words, label = F.lit(False), F.lit(False)
    for t in terms:
        words, label = words | has_word(stem, t), label | has_word(plain_form(F.coalesce(anchor, F.lit(""))), t)
    serves = F.lit(False)
    for s in service:
        serves = serves | has_word(stem, s)
    return F.when((F.size(segments(url)) == 0) | serves, "altro").when(words | label, "programma").otherwise("comunicato")


def relevance(kind: Column, url: Column, years: tuple[str, ...]) -> Column:
    """100, 10 or 0 by type, 10 more for a PDF, 5 more for a year named in the URL."""
    year = F.lit(False)
    for y in years:
        year = year | F.contains(url, F.lit(y))
    base = F.when(kind == "programma", 100).when(kind == "comunicato", 10).otherwise(0)
    return base + F.when(stem_and_extension(url)[1] == "pdf", 10).otherwise(0) + F.when(year, 5).otherwise(0)


def story_domain(*fields: Column) -> Column:
    """The first field that says something."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields])


def capture_url(ts: Column, url: Column, base: str = "https://web.archive.org/web") -> Column:
    return F.format_string(f"{base}/%sid_/%s", ts, url)


def iso_from_capture(ts: Column) -> Column:
    return F.regexp_replace(F.substring(ts, 1, 14), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6Z")


def page_title(html: Column) -> Column:
    return untagged(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_description(html: Column) -> Column:
    """name=description, else og:description."""
    own = F.regexp_extract(html, r"(?is)<meta[^>]*name=\"description\"[^>]*content=\"([^\"]*)\"", 1)
    og = F.regexp_extract(html, r"(?is)<meta[^>]*property=\"og:description\"[^>]*content=\"([^\"]*)\"", 1)
    return unescaped(F.coalesce(F.nullif(own, F.lit("")), og))


def bare(html: Column) -> Column:
    """Without comments, scripts and styles."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")


def paragraph_text(html: Column) -> Column:
    """The text of all <p>, one a line."""
    found = F.regexp_extract_all(bare(html), F.lit(r"(?is)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, untagged), lambda x: x != ""), "\n")


def links(html: Column) -> Column:
    """The targets of a, iframe, embed and object, each once, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<(?:a|iframe|embed|object)\s[^>]*?(?:href|src|data)=\"([^\"]*)\""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def absolute(link: Column, page: Column) -> Column:
    """A link as seen from its page; paths from the root and full URLs are kept, others hang below the page's folder."""
    root = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(page), r"[^/]*$", "")
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link)).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))


def hidden_inputs(html: Column) -> Column:
    """{name: value} of a form's hidden inputs; the last of a name counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<input[^>]*>)"), F.lit(1))
    tags = F.filter(tags, lambda t: t.rlike(r"(?i)type=\"hidden\""))
    pairs = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"(?i)name=\"([^\"]*)\"", 1).alias("k"), F.regexp_extract(t, r"(?i)value=\"([^\"]*)\"", 1).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def page_count(html: Column) -> Column:
    """How many pages a list has, by its line "Pagina n di m"; 1 without one."""
    found = F.regexp_extract(F.regexp_replace(html, r"<[^>]+>", " "), r"Pagina\s+\d+\s+di\s+(\d+)", 1)
    return F.when(found != "", found.cast("int")).otherwise(1)


def named_inputs(html: Column, pattern: str) -> Column:
    """(name, value) of the inputs that have both and whose name has the pattern, in order, entities undone."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<input[^>]*>)"), F.lit(1))
    tags = F.filter(tags, lambda t: t.rlike('name="[^"]+"') & t.rlike('value="[^"]*"'))
    pairs = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, 'name="([^"]+)"', 1).alias("name"), F.btrim(unescaped(F.regexp_extract(t, 'value="([^"]*)"', 1))).alias("value")))
    return F.filter(pairs, lambda p: p["name"].rlike(pattern))


def capture_rows(body: Column) -> Column:
    """A web-archive index (a JSON array of arrays, the first the header) as an array of maps."""
    rows = F.from_json(body, "array<array<string>>")
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_arrays(F.element_at(rows, 1), r))
