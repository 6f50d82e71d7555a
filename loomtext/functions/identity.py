"""Scalars that name, label and locate documents: titles, addresses, ages, keys. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\x0b"
TRACKING = "^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref|source)(=|$)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def flat(text: Column) -> Column:
    """White space as single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def title(text: Column, most: int = 80) -> Column:
    """The first line that isn't blank, cut to `most` characters; "Untitled" without one."""
    line = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.lit(0))
    return F.when(line.isNull(), "Untitled").when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def content_uri(text: Column, source: Column, scheme: str = "doc") -> Column:
    """An address made of the content: scheme, source and the start of the text's SHA-1."""
    return F.concat(F.lit(f"{scheme}:"), source, F.lit("/"), F.substring(F.sha1(text.cast("binary")), 1, 16))


def snippet(text: Column, most: int = 200) -> Column:
    return F.substring(flat(text), 1, most)


def looks_scanned(text: Column, pages: Column) -> Column:
    """Too little text for its pages to have been typed."""
    return F.length(strip(text)) < F.greatest(F.lit(16), pages * 8)


def host(url: Column) -> Column:
    """The address's host in lower case without `www.`."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """The address without its fragment and tracking parameters."""
    base = F.substring_index(url, "#", 1)
    kept = F.filter(F.split(F.regexp_extract(base, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    path = F.regexp_extract(base, r"^([^?]*)", 1)
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def next_page_url(url: Column) -> Column:
    """The address with the number after page, p or pg one higher, leading zeros kept; null without one."""
    pattern = r"^(.*?[/?&](?:page|p|pg)=?)(\d+)(.*)$"
    digits = F.regexp_extract(url, pattern, 2)
    higher = (digits.cast("decimal(38, 0)") + 1).cast("decimal(38, 0)").cast("string")
    padded = F.when(F.length(higher) < F.length(digits), F.lpad(higher, F.length(digits), F.lit("0"))).otherwise(higher)
    return F.when(url.rlike(pattern), F.concat(F.regexp_extract(url, pattern, 1), padded, F.regexp_extract(url, pattern, 3)))


def is_pdf_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^(https?|file):.*\.pdf($|[?#])"), F.lit(False))


def age_label(seconds: Column) -> Column:
    """How long ago, in words."""
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(whole(60), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit(" h ago")))
        .otherwise(F.concat(whole(86400), F.lit(" d ago")))
    )


def short_age(seconds: Column, stamp: Column) -> Column:
    """How long ago, in a list: seconds to days, then the day of the `stamp`; empty without a stamp."""
    whole = lambda unit, name: F.concat(F.floor(F.greatest(seconds, F.lit(0)) / unit).cast("string"), F.lit(f"{name} ago"))
    return (
        F.when(stamp.isNull(), "").when(seconds < 60, whole(1, "s")).when(seconds < 3600, whole(60, "m"))
        .when(seconds < 86400, whole(3600, "h")).when(seconds < 604800, whole(86400, "d")).otherwise(F.date_format(stamp, "dd MMM"))
    )


def typed_age(seconds: Column) -> Column:
    """How long ago someone typed, in words; null: no one has."""
    whole = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {name} ago"))
    return (
        F.when(seconds.isNull(), "no one has typed in it").when(seconds < 60, "just now").when(seconds < 90 * 60, whole(60, "minutes"))
        .when(seconds < 36 * 3600, whole(3600, "hours")).otherwise(whole(86400, "days"))
    )


#: What windows show besides their content (fixed values).
NOISE = (
    "address and search bar", "create split view", "search or enter address", "address field", "back", "forward", "reload", "home",
    "bookmark this tab", "new tab", "close", "minimize", "maximize", "restore", "extensions", "chrome", "you", "search tabs",
    "all bookmarks", "apps", "tab groups", "customize and control google chrome", "bookmarks", "menu",
)


def is_noise(line: Column) -> Column:
    """A window's furniture: nothing, one character, a bare address, or one of NOISE."""
    inner = F.lower(strip(line))
    return (F.length(inner) < 2) | inner.isin(*NOISE) | inner.rlike(r"^https?://\S+$")


def resolved(href: Column, base: Column) -> Column:
    """The address that a link on the page `base` leads to."""
    bare = F.regexp_replace(base, r"#.*$", "")
    page = F.regexp_replace(bare, r"\?.*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.substring(page, F.length(origin) + 1, F.length(page)), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)

    def without_dots(path: Column) -> Column:
        whole, rest = F.regexp_extract(path, r"^([^?#]*)", 1), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
        none = F.array().cast("array<string>")

        def step(acc: Column, part: Column) -> Column:
            up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
            return F.when(part == ".", acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

        ends = F.when(whole.rlike(r"/\.{1,2}$"), "/").otherwise("")
        return F.concat(F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/"), ends, rest)

    h = F.trim(href)
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(h == "", bare)
        .when(F.startswith(h, F.lit("#")), F.concat(bare, h))
        .when(F.startswith(h, F.lit("?")), F.concat(page, h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, without_dots(h)))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, h))))
    )


def short_title(text: Column, most: int = 52) -> Column:
    """The flat text, cut at the last word that fits."""
    line = flat(text)
    head = F.substring(line, 1, most)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.regexp_replace(F.when(head.contains(" "), cut).otherwise(head), r"[ ,.;:-]+$", ""), F.lit("…")))


def project_slug(path: Column) -> Column:
    return F.translate(path, ":\\/", "---")


def project_name(slug: Column) -> Column:
    return F.element_at(F.filter(F.split(slug, "-"), lambda p: p != ""), -1)


def letters_key(text: Column) -> Column:
    """Letters and digits alone, in lower case: what counts as the same capture."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def preview(text: Column, most: int = 90) -> Column:
    line = flat(text)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def padded_words(text: Column) -> Column:
    """Words in lower case, punctuation as spaces, with a space at each end."""
    return F.concat(F.lit(" "), flat(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]+", " "))), F.lit(" "))


def substantial(padded: Column) -> Column:
    """Enough words to be more than a coincidence: four, and twelve characters."""
    inner = F.trim(padded)
    return (F.regexp_count(padded, F.lit(r"\S+")) >= 4) & (F.length(inner) >= 12)


def contained(outer: Column, inner: Column) -> Column:
    return substantial(inner) & outer.contains(inner)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct words that stand in b."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.when(F.size(words(a)) == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / F.size(words(a)))


def bigrams(text: Column) -> Column:
    """The multiset of character pairs of the flat text in lower case: each pair with its number among equal ones, so that a
    plain intersection is the multisets'. Takes time in proportion to the text but for one sort."""
    pairs = F.array_join(F.sort_array(F.regexp_extract_all(flat(F.lower(text)), F.lit(r"(?s)(?=(..))."), 1)), "")
    runs = F.regexp_extract_all(pairs, F.lit(r"(?s)((..)\2*+)"), 1)  # of equal pairs
    several = lambda r: F.transform(F.sequence(F.lit(1), (F.length(r) / 2).cast("int")), lambda k: F.concat(F.left(r, F.lit(2)), k.cast("string")))
    found = F.concat(F.transform(F.filter(runs, lambda r: F.length(r) == 2), lambda r: F.concat(r, F.lit("1"))), F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) > 2), several)))
    return F.coalesce(found, F.array().cast("array<string>"))


def dice(x: Column, y: Column) -> Column:
    """Dice coefficient of two multisets of `bigrams`."""
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2 * shared / (F.size(x) + F.size(y)))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the multisets of character pairs."""
    measured = F.element_at(F.transform(F.array(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y"))), lambda both: dice(both["x"], both["y"])), 1)
    return F.when(a == b, 1.0).otherwise(measured)


def is_gibberish(line: Column) -> Column:
    """Blank, mostly not letters, or mostly lone characters."""
    inner = strip(line)
    letters = F.length(F.regexp_replace(inner, r"[^\p{L}\p{N}]", ""))
    tokens = F.filter(F.split(inner, r"\s+"), lambda t: t != "")
    single = F.size(F.filter(tokens, lambda t: F.length(F.btrim(t, F.lit(".,;:!?-"))) <= 1))
    return (inner == "") | (letters / F.length(inner) < 0.4) | ((F.size(tokens) >= 3) & (single / F.size(tokens) > 0.6))


def without_gibberish(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: ~is_gibberish(x)), "\n")


def prose_score(text: Column) -> Column:
    """Characters in lines of more than 80."""
    long_ = F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) > 80)
    return F.aggregate(long_, F.lit(0), lambda acc, x: acc + F.length(x))


def without_leading_chrome(text: Column) -> Column:
    """The text from its first long line on, if eight lines or more come before it."""

    def cut(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.length(strip(x)) > 80), True)
        return F.when(at > 8, F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), "\n")).otherwise(F.array_join(lines, "\n"))

    return F.element_at(F.transform(F.array(F.split(text, "\n")), cut), 1)


def progress(last_index: Column, total: Column) -> Column:
    return F.when(total > 0, last_index / total).otherwise(0.0)
