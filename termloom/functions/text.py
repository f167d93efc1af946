"""Text functions as Column -> Column; all of them stay in the JVM.

White space means what a Unicode-aware strip or split takes for it, so patterns
spell it out instead of relying on SQL's trim, which removes spaces only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = f"[{_SPACES}]"
#: What a split into lines cuts at.
_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
#: A word character of a Unicode-aware regular expression.
_W = r"\p{L}\p{N}_"
# Addresses: fixed values. A word character at both ends stands for the word boundaries.
_URL = rf"(?i)https?://[^{_SPACES}]+|www\.[^{_SPACES}]+"
# Within a run of word characters only the first can begin an address: each run is gone through once.
_MAIL = rf"(?<![{_W}])[{_W}][{_W}.+-]*+@[{_W}-]+\.[{_W}.-]*[{_W}]"


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: what stands in a lambda is computed anew wherever it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove white space at both ends; only a text that begins or ends with some is searched."""
    return once(c, lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(_WS), F.regexp_replace(t, f"^{_WS}+|{_WS}+$", "")).otherwise(t))


def split_lines(c: Column) -> Column:
    """Lines of a text by any line break; a break at the end makes no further line, an empty text has none."""
    without_last = lambda t: F.when(F.right(t, F.lit(1)).rlike(_BREAK), F.regexp_replace(t, rf"(?:{_BREAK})\z", "")).otherwise(t)
    return once(c, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(without_last(t), _BREAK)))


def text_or_empty(c: Column) -> Column:
    """Missing and empty are one value: stripped text, or ''."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def norm_text(c: Column) -> Column:
    """Without ASCII spaces, stripped; case stays."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))


def without_space(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{_WS}+", "")


def norm_lower(c: Column) -> Column:
    return F.lower(norm_text(c))


def semantic_tag(c: Column) -> Column:
    """What the last parenthesis holds if the term ends with one, else ''."""
    inside = F.regexp_replace(F.substring_index(c, "(", -1), r"\)+$", "")
    return F.when(F.endswith(c, F.lit(")")) & c.contains("("), strip(inside)).otherwise(F.lit(""))


def strip_tag_last(c: Column) -> Column:
    """Cut from the last ' (' on."""
    return F.regexp_replace(c, r"(?s)^(.*) \(.*$", "$1")


def strip_tag_end(c: Column) -> Column:
    """Cut one parenthesis at the end."""
    return strip(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""))


def strip_tag_listed(c: Column, tags: Sequence[str]) -> Column:
    """Cut a parenthesis at the end only if it holds one of these tags."""
    return F.regexp_replace(c, r"\s*\((?:" + "|".join(tags) + r")\)\s*$", "")


def strip_tag_anywhere(c: Column, tag: str) -> Column:
    """Remove ' (tag)' wherever it stands."""
    return F.replace(c, F.lit(f" ({tag})"), F.lit(""))


def parse_fsn(c: Column) -> tuple[Column, Column]:
    """(term, tag) of a fully specified name."""
    pattern = r"\s*\(([^()]+)\)\s*$"
    return F.regexp_replace(c, pattern, ""), F.regexp_extract(c, pattern, 1)


def normalize_key(c: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and space to space, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def corpus_normalize(c: Column) -> Column:
    """For document frequencies: no addresses, digits, punctuation or case; patterns run where what they need stands."""
    out = once(c, lambda t: F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))
    out = once(out, lambda t: F.when(t.contains("://") | t.contains("w.") | t.contains("W."), F.regexp_replace(t, _URL, " ")).otherwise(t))
    out = once(out, lambda t: F.when(t.contains("@"), F.regexp_replace(t, _MAIL, " ")).otherwise(t))
    out = F.lower(F.regexp_replace(out, r"\p{Nd}+", " "))
    return F.trim(F.regexp_replace(out, f"[^{_W}]+", " "))


def light_normalize(c: Column) -> Column:
    """Runs of blanks to one, more than two line ends to two."""
    out = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def markdown_strip(c: Column) -> Column:
    """Drop code fences; keep the words of inline code, images and links."""
    out = F.regexp_replace(c, r"(?s)```.*?```", "")
    out = F.regexp_replace(out, r"`([^`]*)`", "$1")
    out = F.regexp_replace(out, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")


def markdown_plain(c: Column) -> Column:
    """Also without headings, quotes, bullets and table bars."""
    out = F.regexp_replace(markdown_strip(c), r"(?m)^\s{0,3}#{1,6}\s*", "")
    out = F.regexp_replace(out, r"(?m)^\s*>\s?", "")
    out = F.regexp_replace(out, r"(?m)^\s*[-*+]\s+", "")
    return F.replace(out, F.lit("|"), F.lit(" "))


def marker_clean(c: Column) -> Column:
    """The text without the lines that are layout noise."""
    return F.array_join(F.filter(split_lines(c), lambda x: ~is_layout_noise(x)), "\n")


def html_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def clean_cell(c: Column) -> Column:
    """Collapse white space and drop a footnote number at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?<=\D)\s*\d+$", "")


def strip_parens(c: Column) -> Column:
    """(x) -> x."""
    return F.regexp_replace(c, r"\(([^()]*)\)", "$1")


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def has_estonian_marks(c: Column) -> Column:
    return c.rlike("[õäöüšžÕÄÖÜŠŽ]")


def suffix_bucket(c: Column, suffixes: Sequence[str]) -> Column:
    """The suffix the text ends with (longest first), else '_other'."""
    listed = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    found = F.regexp_extract(c, f"({listed})$", 1)
    return F.when(found == "", F.lit("_other")).otherwise(found)


def longest_form(c: Column, forms: Sequence[str], at_end: bool = False) -> Column:
    """The longest form that the text holds (or ends with); of equal length the smaller one; null if none."""
    ordered = sorted(set(forms), key=lambda s: (-len(s), s))
    tests = [F.when(F.endswith(c, F.lit(f)) if at_end else c.contains(f), F.lit(f)) for f in ordered]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def glossary_hits(c: Column, keys: Column, most: int = 6, least: int = 4) -> Column:
    """Keys (an array) that stand as whole phrases in the text, longest first, none inside a kept one."""
    padded = F.concat(F.lit(" "), normalize_key(c), F.lit(" "))
    hits = F.filter(keys, lambda k: (F.length(k) >= least) & padded.contains(F.concat(F.lit(" "), k, F.lit(" "))))
    ranked = F.array_sort(F.transform(hits, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    kept = F.aggregate(ranked, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda a: a.contains(x["k"])), acc).otherwise(F.concat(acc, F.array(x["k"]))))
    return F.slice(kept, 1, most)


def truncate(c: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def template_tokens(template: str) -> list[str]:
    """Names in {{name}} marks."""
    import re

    return re.findall(r"\{\{\s*([\w.]+)\s*\}\}", template)


def render_template(template: str, values: dict[str, Column]) -> Column:
    """The template with its marks filled; a mark without a value is an error."""
    import re

    unknown = [t for t in template_tokens(template) if t not in values]
    if unknown:
        raise ValueError(f"unknown template names: {sorted(set(unknown))}")
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([\w.]+)\s*\}\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def pair_table(pairs: Column, empty: str = "(no examples)", heads: tuple[str, str] = ("English", "Target")) -> Column:
    """A markdown table of an array of (en, target) structs."""
    rows = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("| "), p["en"], F.lit(" | "), p["target"], F.lit(" |"))), "\n")
    return F.when(F.size(pairs) > 0, F.concat(F.lit(f"| {heads[0]} | {heads[1]} |\n|---|---|\n"), rows)).otherwise(F.lit(empty))


def context_sections(sections: Sequence[tuple[str, Column]]) -> Column:
    """Titled sections joined by a blank line; null or empty ones are left out."""
    parts = [F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}\n"), body)) for title, body in sections]
    return F.concat_ws("\n\n", *parts)


def first_line(c: Column) -> Column:
    """First non-blank line after thinking blocks are dropped, else the stripped text."""
    cleaned = without_thinking(c)
    lines = F.filter(F.transform(F.split(cleaned, "\n"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), strip(cleaned))


def without_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


# Header words and signs of layout noise: fixed values.
SECTION_KEYWORDS = ("references", "reference", "additional information", "additional info", "lisainfo", "viited", "allikad", "kasutatud kirjandus", "kirjandus", "used literature", "bibliography", "version", "koostaja", "author", "authors", "contact", "kontakt")
_PAGE = rf"(?iu)^(page|lk\.?|lehek(ülg|g))?{_WS}*\p{{Nd}}+{_WS}*((/|of){_WS}*\p{{Nd}}+)?$"
_PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{_SPACES}().-]{{6,}}\p{{Nd}}"
_PHONE_WORDS = "tel|telefon|phone|kontakt"
_AUTHOR_WORDS = "koostaja|author|authors|contact|kontakt|version|versioon"
_ADDRESS_WORDS = "tn|tänav|street|st|road|rd|ave|avenue|puiestee"


def _has_word(c: Column, words: str) -> Column:
    """One of the words stands there, not inside a longer one."""
    return c.rlike(rf"(?iu)(?<![{_W}])({words})(?![{_W}])")


def header_of(line: Column) -> Column:
    """Struct (is_header, level, title) of a line; the level is known for markdown headers only."""
    heading = rf"(?s)^(#{{1,6}}){_WS}+(.*)\z"
    none = F.struct(F.lit(False).alias("is_header"), F.lit(None).cast("int").alias("level"), F.lit("").alias("title"))

    def marked(hashes: Column) -> Column:
        return F.struct(F.lit(True).alias("is_header"), F.length(hashes).alias("level"), strip(F.regexp_extract(line, heading, 2)).alias("title"))

    def capital(bare: Column) -> Column:
        def of(letters: Column) -> Column:
            words = F.size(F.filter(F.split(letters, f"{_WS}+"), lambda w: w != ""))
            return (letters != "") & (letters == F.upper(letters)) & (words <= 10)

        letters = F.regexp_replace(bare, rf"[^A-Za-zÀ-ÖØ-öø-ÿÕÄÖÜŠŽ{_SPACES}-]", "")
        named = F.struct(F.lit(True).alias("is_header"), F.lit(None).cast("int").alias("level"), bare.alias("title"))
        small = bare.rlike("[a-zß-öø-ÿ]")  # what upper case would change
        return F.when((bare != "") & (F.length(bare) <= 120) & ~small & once(letters, of), named).otherwise(none)

    hashes = F.when(F.startswith(line, F.lit("#")), F.regexp_extract(line, heading, 1)).otherwise(F.lit(""))
    return once(hashes, lambda h: F.when(h != "", marked(h)).otherwise(once(strip(line), capital)))


def skip_sections(lines: Column, keywords: Sequence[str] = SECTION_KEYWORDS) -> Column:
    """Lines outside sections whose header holds a keyword.

    A skipped section ends at a header of the same or a higher level; a header of
    unknown level always ends it. Only the headers are gone through in order; the
    lines from where skipping begins or ends to the next such place are cut out whole.
    """
    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("int").alias("level"), F.array(F.struct(F.lit(1).alias("at"), F.lit(False).alias("skip"))).alias("out"))

    def marked(line: Column, i: Column) -> Column:
        def titled(h: Column) -> Column:
            def named(title: Column) -> Column:
                hit = F.lit(False)
                for k in keywords:
                    hit = hit | title.contains(k.lower())
                return hit

            return F.when(h["is_header"], F.struct((i + 1).alias("at"), once(F.lower(h["title"]), named).alias("named"), h["level"].alias("level")))

        return once(header_of(line), titled)

    def step(acc: Column, h: Column) -> Column:
        ends = h["level"].isNull() | acc["level"].isNull() | (h["level"] <= acc["level"])
        skipping = acc["skip"] & ~ends
        begins = ~skipping & h["named"]
        skip = skipping | begins
        out = F.when(skip == acc["skip"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(h["at"].alias("at"), skip.alias("skip")))))
        return F.struct(skip.alias("skip"), F.when(begins, h["level"]).when(skipping, acc["level"]).alias("level"), out.alias("out"))

    def of(lines: Column) -> Column:
        def kept(parts: Column) -> Column:
            def part(p: Column, i: Column) -> Column:
                end = F.coalesce(F.try_element_at(parts, i + 2)["at"], F.size(lines) + 1)
                return F.when(p["skip"] | (end <= p["at"]), F.array().cast("array<string>")).otherwise(F.slice(lines, p["at"], end - p["at"]))

            return F.flatten(F.transform(parts, part))

        headers = F.array_compact(F.transform(lines, marked))
        return once(F.aggregate(headers, start, step, lambda acc: acc["out"]), kept)

    return once(lines, of)


def is_layout_noise(line: Column) -> Column:
    """Page numbers, addresses, contact and author lines, rules."""

    def of(bare: Column) -> Column:
        short = F.length(bare) <= 200
        return (bare != "") & (
            bare.rlike(_PAGE)
            | bare.rlike(_URL)
            | (bare.contains("@") & bare.rlike(_MAIL))
            | (bare.rlike(_PHONE) & _has_word(bare, _PHONE_WORDS))
            | (short & _has_word(bare, _AUTHOR_WORDS))
            | (short & bare.rlike(r"\p{Nd}") & _has_word(bare, _ADDRESS_WORDS))
            | bare.rlike("^[-_=]{4,}$")
        )

    return once(strip(line), of)


def paragraphs(c: Column, least: int = 40, most: int = 800) -> Column:
    """Paragraphs of ``least`` to ``most`` characters; longer ones by lines; shorter ones are dropped."""
    paras = F.filter(F.transform(F.split(c, rf"\n{_WS}*\n"), strip), lambda p: p != "")
    split = F.transform(paras, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.transform(split_lines(p), strip)))
    return F.filter(F.flatten(split), lambda p: F.length(p) >= least)


def contrast_order(en: Column, target: Column, en_pattern: str, target_pattern: str) -> Column:
    """'contrast_first' or 'site_first' where the English term is of the kind, else null."""
    return F.when(en.rlike(en_pattern), F.when(target.rlike(target_pattern), "contrast_first").otherwise("site_first"))


def triggered(term: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Texts of the rules of which a trigger is in the lower-case term, in order."""
    low = F.lower(term)
    out = []
    for triggers, text in rules:
        hit = F.lit(False)
        for t in triggers:
            hit = hit | low.contains(t.lower())
        out.append(F.when(hit, F.lit(text)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def parse_trigger_rules(markdown: str) -> list[tuple[list[str], str]]:
    """Rules of the form '**trigger, trigger**: text', by line."""
    import re

    found = []
    for line in markdown.splitlines():
        m = re.match(r"\s*[-*]?\s*\*\*(.+?)\*\*\s*:?\s*(.+)$", line)
        if m:
            found.append(([t.strip().lower() for t in re.split(r"[,/]", m[1]) if t.strip()], m[2].strip()))
    return found


def parse_sections(markdown: str) -> dict[str, str]:
    """First-level headings and their bodies; text before the first goes, a repeated heading's last body stays."""
    out: dict[str, list[str]] = {}
    at = None
    for line in markdown.splitlines():
        if line.startswith("# "):
            at = line[2:].strip()
            out[at] = []
        elif at is not None:
            out[at].append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


def sentence_chunks(c: Column, size: int = 1024, overlap: int = 200) -> Column:
    """Chunks of whole sentences of up to ``size`` characters; the last sentences of a chunk, up to
    ``overlap`` characters, begin the next one. A longer sentence is a chunk of its own."""
    sentences = F.filter(F.split(strip(F.regexp_replace(c, r"\s+", " ")), r"(?<=[.!?]) "), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("now"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x) + 1)

    def carried(now: Column) -> Column:
        back = F.aggregate(F.reverse(now), F.array().cast("array<string>"), lambda acc, x: F.when(total(acc) + F.length(x) + 1 <= overlap, F.concat(acc, F.array(x))).otherwise(acc))
        return F.reverse(back)

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (total(acc["now"]) + F.length(x) > size)
        return F.struct(F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["out"]).alias("out"), F.when(full, F.concat(carried(acc["now"]), F.array(x))).otherwise(F.concat(acc["now"], F.array(x))).alias("now"))

    return F.aggregate(sentences, empty, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["out"]))
