"""Text functions as column builders; all stay in the JVM unless the docstring says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))

# Fixed values, as other tools in the field have them, so that results agree: noise between words and specifications,
# unit factors, citation aliases and default years, words of refusal, the form of a number, ends of sentences.
NAME_NOISE = " \t×x·*/、，,()（）[]【】　"
UNIT_FACTORS = {("千块", "块"): 1000.0, ("百块", "块"): 100.0, ("千米", "m"): 1000.0, ("千米", "米"): 1000.0}
CITATION_ALIAS = {
    "混规": "GB50010", "抗规": "GB50011", "地规": "GB50007", "荷规": "GB50009", "高规": "JGJ3",
    "混凝土规范": "GB50010", "抗震规范": "GB50011", "地基规范": "GB50007", "荷载规范": "GB50009",
}
CITATION_YEAR = {"GB50010": "2010", "GB50011": "2010", "GB50007": "2011", "GB50009": "2012", "JGJ3": "2010"}
REFUSAL = r"无法(?:仅凭|确定|回答)|不能(?:仅凭|确定)|未(?:明确|提供)|并未提供|信息不足|超出(?:本条|该条|条款)范围|需要.*(?:专业|工程师|现场).*判断|建议由.*(?:工程师|专业人员)"
NUMBER = r"(?<![\w.])[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?%?"
SENTENCE_ENDS = r"[。！？!?；;\n]+"

CLAUSE = r"\d+(?:\.\d+){1,3}"


def collapse_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def narrow(text: Column) -> Column:
    """Full-width ASCII forms as plain ASCII."""
    return F.translate(text, _WIDE, _NARROW)


def plain_name(text: Column) -> Column:
    """Name for similarity: half width, without noise marks, lower case."""
    return F.lower(F.translate(narrow(F.coalesce(text, F.lit(""))), NAME_NOISE, ""))


def resource_text(text: Column) -> Column:
    """Name for equality: lower case, marks unified, without brackets and white space."""
    marks = F.translate(F.lower(F.coalesce(text, F.lit(""))), "×（）～，", "x()~,")
    return F.regexp_replace(marks, r"[()\s　]", "")


def canonical_key(name: Column, spec: Column) -> Column:
    """Equal for a name with its specification inside and for the two apart."""
    return resource_text(F.concat(F.coalesce(name, F.lit("")), F.coalesce(spec, F.lit(""))))


def canonical_unit(unit: Column) -> Column:
    out = F.replace(F.coalesce(unit, F.lit("")), F.lit("$"), F.lit(""))
    for old, new in (("^3", "³"), ("^2", "²"), ("m3", "m³"), ("m2", "m²")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def caption_parts(caption: Column) -> Column:
    """(work, unit) of a caption that names the work content and the unit; what is missing is empty."""
    work = F.trim(F.regexp_extract(caption, r"工作内容[:：](.*?)(?:单位[:：]|$)", 1))
    unit = F.regexp_replace(F.regexp_extract(caption, r"单位[:：]\s*(\S+)", 1), r"\\mathrm|\\mathbf|\\,|[{}]", "")
    return F.struct(F.coalesce(work, F.lit("")).alias("work"), F.coalesce(canonical_unit(unit), F.lit("")).alias("unit"))


def caption_category(caption: Column) -> Column:
    """The words of a table's caption between its number and its code."""
    plain = F.regexp_replace(F.coalesce(caption, F.lit("")), r"\s+", "")
    named = F.regexp_replace(F.regexp_replace(plain, r"^续?表[A-Za-z\d.-]*", ""), r"[（(]编[码号][:：][^）)]*[）)]", "")
    return F.regexp_replace(named, r"^[:：]+|[:：]+$", "")


def unit_factor(from_unit: Column, to_unit: Column) -> Column:
    """Price factor between units: 1.0 if equal, null if they don't convert."""
    a, b = canonical_unit(from_unit), canonical_unit(to_unit)
    out = F.when(a == b, 1.0)
    for (x, y), factor in UNIT_FACTORS.items():
        out = out.when((a == x) & (b == y), factor)
    return out


def windows(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters in order; none where the text is shorter."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.transform(spots, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def grams(text: Column, n: int = 2) -> Column:
    """Distinct ``n``-grams of a plain name; a shorter name is its own gram, an empty one has none."""
    t = plain_name(text)
    return F.array_distinct(F.when((F.length(t) > 0) & (F.length(t) < n), F.array(t)).otherwise(windows(t, n)))


def grams12(text: Column) -> Column:
    """Distinct single characters and pairs, without digits, blanks and marks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\d/()（）.、-]", "")
    return F.array_distinct(F.concat(windows(t, 1), windows(t, 2)))


def coverage(target: Column, found: Column) -> Column:
    """Share of ``target``'s grams that ``found`` has; 0.0 without grams."""
    return F.when(F.size(target) > 0, F.size(F.array_intersect(target, found)) / F.size(target)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term``; 0 for an empty one."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("int")


def term_score(text: Column, query: str, terms: list[str]) -> Column:
    """5 for the whole query, and 1 + 0.2 * min(count, 3) for each term that occurs."""
    score = F.when(text.contains(query), 5.0).otherwise(0.0) if query else F.lit(0.0)
    for term in terms:
        n = occurrences(text, F.lit(term))
        score = score + F.when(n > 0, 1 + 0.2 * F.least(n, F.lit(3))).otherwise(0.0)
    return score


def marker_penalty(name: Column, query: Column, markers: list[str], each: float = 0.1) -> Column:
    """A penalty for every marker that the name has and the query did not ask for."""
    out = F.lit(0.0)
    for m in markers:
        out = out + F.when(name.contains(m) & ~query.contains(m), each).otherwise(0.0)
    return out


def numbers(text: Column) -> Column:
    """Numbers as written, with sign, exponent and percent sign."""
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def number_values(text: Column) -> Column:
    """Numbers as decimals, so that 0.20 equals 0.2; a percent sign is dropped."""
    found = F.transform(numbers(text), lambda x: F.regexp_replace(x, "%$", "").cast("double").cast("decimal(38,10)"))
    return F.filter(found, lambda x: x.isNotNull())


def number_strings(text: Column) -> Column:
    """Distinct digits-and-points strings."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d.]*"), 0), lambda x: F.regexp_replace(x, r"[^\d.]", "")), lambda x: x != "."))


def numbers_conflict(answer: Column, source: Column, spared: tuple[str, ...] = ("0", "1", "2", "3", "4"), most: int = 2) -> Column:
    """More than ``most`` numbers of the answer are not in a source that has numbers."""
    known, said = number_strings(source), number_strings(answer)
    extra = F.array_except(F.array_except(said, known), F.array(*map(F.lit, spared)))
    return (F.size(known) > 0) & (F.size(extra) > most)


def is_refusal(text: Column) -> Column:
    return text.rlike(REFUSAL)


@F.pandas_udf(BooleanType())
def is_repetitive(texts: pd.Series) -> pd.Series:
    """80 characters or more, of which a sentence of 12 or a run of 24 comes three times (Arrow batches)."""
    import re
    from collections import Counter

    def one(text: str | None) -> bool:
        t = re.sub(r"\s+", "", text or "")
        if len(t) < 80:
            return False
        parts = Counter(p for p in re.split(SENTENCE_ENDS, t) if len(p) >= 12)
        if parts and max(parts.values()) >= 3:
            return True
        return max(Counter(t[i : i + 24] for i in range(len(t) - 23)).values()) >= 3

    return texts.map(one)


def _citation(std: Column, year: Column, clause: Column) -> Column:
    """Id of a clause: standard, year if known, number."""
    code = F.upper(F.regexp_replace(F.regexp_replace(std, r"\s+", ""), "(?i)/T", ""))
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CITATION_YEAR.items() for x in kv]), code), F.lit(""))
    when = F.when(F.coalesce(year, F.lit("")) != "", year).otherwise(known)
    return F.when(when != "", F.concat(code, F.lit("-"), when, F.lit("_"), clause)).otherwise(F.concat(code, F.lit("_"), clause))


def citations(text: Column, default_standard: Column | None = None) -> Column:
    """Distinct clause ids: full references, then aliases, then bare numbers of the default standard."""
    # a standard's code, perhaps its year, then the number; an alias and the number; or a bare number of the default standard
    code = r"((?:GB\s*(?:/?\s*T)?\s*\d{4,5})|(?:JGJ\s*\d+))"
    full = rf"(?i){code}(?:[—-]\s*(\d{{4}}))?[\s第]*({CLAUSE})"
    alias = rf"({'|'.join(CITATION_ALIAS)})[》\s第]*({CLAUSE})"
    bare = rf"第\s*({CLAUSE})\s*条"
    part = lambda pattern, i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    three = F.arrays_zip(part(full, 1).alias("s"), part(full, 2).alias("y"), part(full, 3).alias("c"))
    names = F.create_map(*[F.lit(x) for kv in CITATION_ALIAS.items() for x in kv])
    two = F.arrays_zip(part(alias, 1).alias("a"), part(alias, 2).alias("c"))
    out = F.concat(
        F.transform(three, lambda r: _citation(r["s"], r["y"], r["c"])),
        F.transform(two, lambda r: _citation(F.element_at(names, r["a"]), F.lit(""), r["c"])),
    )
    if default_standard is not None:
        given = F.transform(part(bare, 1), lambda c: _citation(default_standard, F.lit(""), c))
        out = F.concat(out, F.when(F.coalesce(default_standard, F.lit("")) != "", given).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


@F.pandas_udf(ArrayType(StructType([StructField("to", StringType()), StructField("type", StringType())])))
def typed_references(texts: pd.Series) -> pd.Series:
    """Numbers of clauses that a text refers to, typed by the ten characters before each (Arrow batches).

    ``exclude`` after words of exception, ``weak`` after words of comparison, ``cross_standard`` right after a
    standard's code, else ``strong``. Numbers before a unit, and numbers of figures and tables, are none.
    """
    import re

    number = re.compile(r"(?<![\d.])\d+(?:\.\d+){1,3}(?![\d.])")
    unit = re.compile(r"\s*(?:mm|cm|km|m|kg|kN|MPa|kPa|Pa|%|‰|°|t|N)(?![A-Za-z])")

    def one(text: str | None) -> list[dict]:
        out: dict[tuple, dict] = {}
        for m in number.finditer(text or ""):
            before = text[max(0, m.start() - 10) : m.start()]
            if unit.match(text, m.end()) or re.search(r"[图表式]\s*$", before):
                continue
            kind = "strong"
            if re.search(r"(?:GB|JGJ)\s*[/T]*\s*\d+\S*\s*(?:第\s*)?$", before):
                kind = "cross_standard"
            elif re.search(r"除|不适用|另有", before):
                kind = "exclude"
            elif re.search(r"参照|参见|可按|宜按", before):
                kind = "weak"
            out.setdefault((m[0], kind), {"to": m[0], "type": kind})
        return list(out.values())

    return texts.map(one)


def numbered_list(text: Column) -> Column:
    """``1.a2.b`` as [a, b]; a text without numbers is one entry."""
    parts = F.split(text, r"(?=(?<!\d)\d+[.、](?!\d))")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*\d+[.、]", ""))), lambda p: p != "")


def heading_path(text: Column) -> Column:
    """Path of a heading: appendix, appendix number, clause number, or the first 30 characters; null for a cross reference."""
    appendix = F.regexp_extract(text, r"^附录\s*([A-Z])", 1)
    lettered = F.regexp_extract(text, r"^([A-Z](?:\.\d+)+)", 1)
    numbered = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)(?=[\s一-鿿])", 1)
    return (
        F.when(appendix != "", F.concat(F.lit("附录"), appendix))
        .when(lettered != "", lettered)
        .when((numbered != "") & text.rlike(r"^\d+(?:\.\d+)*[节条款项]"), None)
        .when(numbered != "", numbered)
        .otherwise(F.trim(F.substring(text, 1, 30)))
    )


def heading_confidence(text: Column) -> Column:
    """1.0 for numbered headings, 0.6 for others, null for cross references."""
    path = heading_path(text)
    return F.when(path.isNull(), None).when(path.rlike(r"^(附录[A-Z]|[A-Z](\.\d+)+|\d+(\.\d+)*)$"), 1.0).otherwise(0.6)


def path_parent(path: Column) -> Column:
    """5.3.4 -> 5.3, E.1 -> 附录E, 5 and titles -> null."""
    cut = F.regexp_replace(path, r"\.\d+$", "")
    return (
        F.when(path.rlike(r"^[A-Z](\.\d+){2,}$"), cut)
        .when(path.rlike(r"^[A-Z]\.\d+$"), F.concat(F.lit("附录"), cut))
        .when(path.rlike(r"^\d+(\.\d+)+$"), cut)
    )


def path_ancestors(path: Column) -> Column:
    """All ancestors by number, the nearest first: E.1.2 -> E.1, 附录E; a title has none."""
    parts = F.split(path, r"\.")
    above = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))))
    cut = F.transform(above, lambda k: F.concat(F.when((k == 1) & path.rlike("^[A-Z]"), "附录").otherwise(""), F.concat_ws(".", F.slice(parts, 1, k))))
    return F.when(path.rlike(r"^(\d+|[A-Z])(\.\d+)+$"), cut).otherwise(F.array().cast("array<string>"))


def path_depth(path: Column) -> Column:
    """Levels of a path: 5 -> 1, 5.3 -> 2, 附录E -> 1, E.1 -> 2, a title -> 1."""
    return F.when(path.rlike(r"^(\d+|[A-Z])(\.\d+)*$"), F.size(F.split(path, r"\."))).otherwise(1)


def path_contains(outer: Column, inner: Column) -> Column:
    """A path contains itself and what is below it."""
    return (outer == inner) | F.startswith(inner, F.concat(outer, F.lit(".")))


def verdict(text: Column) -> Column:
    """TRUE for YES without NO, FALSE for NO without YES, else null; thinking is taken off first."""
    plain = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", ""))
    yes, no = plain.rlike(r"\bYES\b"), plain.rlike(r"\bNO\b")
    return F.when(yes & ~no, True).when(no & ~yes, False)


def truncate_bytes(text: Column, most: int = 10_240, marker: str = "…[truncated]") -> Column:
    """At most ``most`` UTF-8 bytes, cut between characters, then the marker."""
    valid = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    cut = F.when(F.startswith(text, valid), valid).otherwise(F.regexp_replace(valid, "�+$", ""))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(marker))).otherwise(text)


def joined(*parts: Column, by: str = "\n") -> Column:
    """The parts that are not blank, joined."""
    return F.concat_ws(by, *[F.when(F.trim(p) != "", p) for p in parts])


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))


def feature_texts(path: Column, title: Column, body: Column, captions: Column, tables: Column, ancestors: Column) -> dict[str, Column]:
    """What a section is searched by, from its own parts; blank parts are left out.

    ``raw``: the body as it is. ``sparse``: path, title, body and whole tables by line. ``dense``: title, body and table
    captions by line. ``context_aug``: titles of the ancestors, then the body (or the title) with captions.
    ``captions`` and ``tables`` are texts, ``ancestors`` an array of titles from the root down.
    """
    lines = lambda *parts: F.concat_ws("\n", *[_filled(p) for p in parts])
    above = F.array_join(F.filter(F.coalesce(ancestors, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != ""), " / ")
    own = lines(F.coalesce(_filled(body), _filled(title)), captions)
    return {
        "raw": body,
        "sparse": lines(path, title, body, tables),
        "dense": lines(title, body, captions),
        "context_aug": F.when(above != "", F.concat(above, F.lit(" ‖ "), own)).otherwise(own),
    }


def item_text(name: Column, features: Column, category: Column, chapter: Column) -> Column:
    """An item as a text to embed: its name, its features, its category unless that is the name, its chapter."""
    named = F.transform(F.filter(F.coalesce(features, F.array().cast("array<string>")), lambda f: F.trim(F.coalesce(f, F.lit(""))) != ""), lambda f: F.trim(f))
    return F.concat_ws(
        "。", F.trim(name), F.when(F.size(named) > 0, F.concat(F.lit("特征:"), F.array_join(named, "/"))), F.when(F.trim(category) != F.trim(name), _filled(category)), _filled(chapter)
    )


def table_text(caption: Column, header: Column, body: Column) -> Column:
    """A caption, header and rows as text: cells by `` | ``, rows by line."""
    row = lambda cells: F.concat_ws(" | ", cells)
    return F.concat_ws("\n", F.when(F.trim(caption) != "", caption), F.when(F.size(header) > 0, row(header)), F.when(F.size(body) > 0, F.array_join(F.transform(body, row), "\n")))


def tail_rule(score: Column, wanted: Column, name: Column, factor: float = 0.3) -> Column:
    """A score counts ``factor`` where the last character of what is wanted is not in the name."""
    plain = F.regexp_replace(F.coalesce(wanted, F.lit("")), r"[\s\d/()（）.、-]", "")
    last = F.substring(plain, -1, 1)
    return F.when((plain != "") & ~F.contains(F.coalesce(name, F.lit("")), last), score * factor).otherwise(score)


def extract_json(kind: str = "object"):
    """A pandas UDF: the outermost JSON of a model's answer, escapes repaired if need be; null if there is none."""
    import json
    import re

    outer = re.compile(r"\{[\s\S]*\}" if kind == "object" else r"\[[\s\S]*\]")
    pair = re.compile(r'\\(["\\])|\\')

    def load(blob: str):
        for text in (blob, pair.sub(lambda m: m[0] if m[1] else "\\\\", blob)):
            try:
                return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
            except ValueError:
                pass
        return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [outer.search(re.sub(r"```(?:json)?\s*", "", t or "").strip().rstrip("`").strip()) for t in texts]
            yield pd.Series([load(m[0]) if m else None for m in found], dtype=object)

    return F.pandas_udf(run, StringType())
