"""Secret scan: patterns for known kinds, and sliding-window entropy for the rest.

Base kinds are found as leftmost non-overlapping matches of their pattern over the whole text.
Matches that fail their length test are dropped after matching, as they have used up their text.
The fourth kind, entropy, looks at candidate strings (runs of one character class, cut into pieces by base
spans and by segments with an allow-listed word): a window of
fixed width slides over the candidate while the counts of its characters and the sum of c*log2(c)
are kept up to date by one addition and one removal a step; where the window's Shannon entropy
reaches the class's threshold, the candidate is reported from its first such window to its last.
Candidates with an allow-listed form, and those that a base span overlaps, are suppressed.

Spans are in code points, end exclusive. Null texts count as empty; texts without secrets have an
empty array; repeated rows are scanned each. One map-side pass of built-in expressions; the costly
ones run only for texts that a cheap pattern lets through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import ident

# The base kinds' patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
#: Sieves: a text without a match of these can't have a span of the kind.
ASSIGN_SIEVE = ASSIGN[:-2] + "{%d,})" % ASSIGN_LEAST
# Forms that aren't secrets; words speak for their segment between / and =, the others for a whole candidate.
ALLOWED_WORDS = r"example|sample|placeholder|changeme|dummy|your[_-]|x{6,}|0{8,}|0123456789|abcdefgh"
ALLOWED = r"(?i)" + ALLOWED_WORDS + r"|^(?=[0-9a-f]*+[g-z+/_=-])[^0-9]++$|^[0-9-]+$|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[a-z]++(?:[_/=+-]++[a-z]++)*+[0-9]{0,4}$"
#: What divides a run: base spans, and segments with an allow-listed word. As matches of a class they are suppressed.
CUT = "(?:%s|%s|%s|%s)" % (ASSIGN_SIEVE, ACCESS, HEX, r"(?<![A-Za-z0-9+_-])(?=[A-Za-z0-9+_-]*?(?i:" + ALLOWED_WORDS + "))[A-Za-z0-9+_-]++")
# Entropy classes as (pattern, window, least bits a character). Repetition is possessive: linear, and no recursion on long runs.
CLASSES = {
    "hex": (r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9+/_=-])", 20, 3.0),
    "base64": (CUT + "|(?:(?!" + CUT + ")[A-Za-z0-9+/_=-]){20,}+", 20, 3.7),
}
#: Texts without a match of this have no candidate of the class.
SIEVES = {"hex": CLASSES["hex"][0], "base64": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"}
REPLACEMENT = "[SECRET]"
#: Items of a running sum that are gone through in one go.
BLOCK = 64
#: Characters that a text is cut into before it is put together anew.
CHUNK_CHARS = 4_096

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _span(start: Column, rank: int, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def _once(value: Column, then) -> Column:  # noqa: ANN001
    """then(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _before(values: Column, combine, first: int = 0) -> Column:  # noqa: ANN001
    """For each of an array of int what combine makes of first and all before it. Block by block, as an array grows by copying."""

    def run(block: Column, offset: Column) -> Column:
        start = F.struct(offset.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def blocked(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(first), combine))
        return F.flatten(F.zip_with(blocks, run(whole, F.lit(first)), run))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK))
    return _once(_once(values, cut), blocked)


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, text) of each match: the lengths of what lies between and of the matches add up to their places."""
    hit = lambda x: F.coalesce(F.length(x["hit"]), F.lit(0))
    place = lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + hit(x)).alias("end"), x["hit"].alias("hit"))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    placed = _once(found, lambda all_: F.zip_with(all_, _before(F.transform(all_, lambda x: F.length(x["gap"]) + hit(x)), lambda a, b: a + b), place))
    return F.filter(placed, lambda m: m["hit"].isNotNull())


def _apart(found: Column, base: Column) -> Column:
    """The matches (disjoint) that no base span overlaps. Both in one order: a span that reaches into a match starts before it or comes next."""
    event = lambda x, own, hit: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), hit.alias("hit"))
    events = F.sort_array(F.concat(F.transform(base, lambda b: event(b, 0, F.lit(None).cast("string"))), F.transform(found, lambda m: event(m, 1, m["hit"]))))

    def judged(all_: Column) -> Column:
        reach = _before(F.transform(all_, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(0)), _larger)
        after = F.transform(all_, lambda e, i: F.when(F.get(all_, i + 1)["own"] == 0, F.get(all_, i + 1)["start"]))
        with_both = F.zip_with(F.zip_with(all_, reach, lambda e, r: F.struct(e.alias("e"), r.alias("reach"))), after, lambda x, a: F.struct(x["e"].alias("e"), x["reach"].alias("reach"), F.coalesce(a, x["e"]["end"]).alias("after")))
        return F.transform(F.filter(with_both, lambda x: (x["e"]["own"] == 1) & (x["reach"] <= x["e"]["start"]) & (x["after"] >= x["e"]["end"])), lambda x: x["e"])

    return _once(events, judged)


def hot_windows(candidate: Column, width: int, least: float) -> Column:
    """(first, last): starts of the first and last window whose entropy reaches least; first is -1 where none does.

    A step adds one character to the window's sum of c*log2(c) and takes one off; the two counts that this needs are those of the
    window's own characters.
    """
    xlog = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))

    def slide(codes: Column) -> Column:
        def step(s: Column, new: Column) -> Column:
            full = s["at"] >= width
            old = F.when(full, F.get(codes, s["at"] - width)).otherwise(F.lit(-1))
            window = F.slice(codes, F.greatest(s["at"] - width, F.lit(0)) + 1, F.least(s["at"], F.lit(width)))
            # both counts in one number
            both = F.aggregate(window, F.lit(0), lambda n, c: n + F.when(c == new, 1).otherwise(0) + F.when(c == old, 1 << 16).otherwise(0))

            def moved(n: Column) -> Column:
                gone, now = F.shiftright(n, 16), n.bitwiseAND(F.lit((1 << 16) - 1)) - F.when(old == new, 1).otherwise(0)
                total = s["sum"] + F.when(full, xlog(gone - 1) - xlog(gone)).otherwise(F.lit(0.0)) + xlog(now + 1) - xlog(now)
                return _once(total, judged)

            def judged(total: Column) -> Column:
                hit = (s["at"] + 1 >= width) & (F.lit(math.log2(width)) - total / width >= least)
                begin = s["at"] - (width - 1)
                return F.struct(total.alias("sum"), (s["at"] + 1).alias("at"), F.when(hit & (s["first"] < 0), begin).otherwise(s["first"]).alias("first"), F.when(hit, begin).otherwise(s["last"]).alias("last"))

            return _once(both, moved)

        state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(codes, state, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return _once(F.transform(F.split(candidate, ""), lambda c: F.ascii(c)), slide)


def _entropy_spans(text: Column, base: Column, pattern: str, width: int, least: float) -> Column:
    candidates = F.filter(_apart(_matches(text, pattern), base), lambda m: ~m["hit"].rlike(ALLOWED))
    hot = F.transform(candidates, lambda m: F.struct(m["start"].alias("start"), hot_windows(m["hit"], width, least).alias("hot")))
    return F.transform(F.filter(hot, lambda m: m["hot"]["first"] >= 0), lambda m: _span(m["start"] + m["hot"]["first"], 3, m["start"] + m["hot"]["last"] + width, "entropy"))


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", entropy: bool = True) -> DataFrame:
    """docs with out: an array of spans (start, rank, end, kind), by start, then kind as listed. A column of that name is replaced."""
    none = F.array().cast(f"array<{SPAN}>")
    text = F.coalesce(F.col(ident(text_col)), F.lit(""))
    assign = F.transform(F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], "^(?:" + ASSIGN + ")$", 2)) >= ASSIGN_LEAST), lambda m: _span(m["start"], 0, m["end"], "assign"))
    access = F.transform(_matches(text, ACCESS), lambda m: _span(m["start"], 1, m["end"], "access"))
    hexes = F.transform(_matches(text, HEX), lambda m: _span(m["start"], 2, m["end"], "hex"))
    base = F.concat(*[F.when(text.rlike(sieve), spans).otherwise(none) for sieve, spans in ((ASSIGN_SIEVE, assign), (ACCESS, access), (HEX, hexes))])
    docs = docs.withColumn(out, base)
    if entropy:
        more = [F.when(text.rlike(SIEVES[name]), _entropy_spans(text, F.col(ident(out)), *c)).otherwise(none) for name, c in CLASSES.items()]
        docs = docs.withColumn(out, F.concat(F.col(ident(out)), F.array_distinct(F.concat(*more))))
    return docs.withColumn(out, F.sort_array(F.col(ident(out))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text", replacement: str = REPLACEMENT) -> DataFrame:
    """docs with every span of every text replaced; texts without spans stay as they are, rows and columns too."""
    from vectide.llm.common import free_name

    at = free_name(docs, "secret_spans")
    found = find_spans(docs, text_col, at)
    text, spans = F.col(ident(text_col)), F.col(ident(at))

    def rewritten(chunks: Column) -> Column:
        def part(lo: Column, hi: Column) -> Column:
            # a place in a chunk is found from the chunk's start, not from the text's
            first, last = F.floor(lo / CHUNK_CHARS).cast("int"), F.floor(hi / CHUNK_CHARS).cast("int")
            head, tail = F.coalesce(F.get(chunks, first), F.lit("")), F.coalesce(F.get(chunks, last), F.lit(""))
            here, rest = F.substring(head, lo % CHUNK_CHARS + 1, hi - lo), F.substring(head, lo % CHUNK_CHARS + 1, F.lit(CHUNK_CHARS))
            between = F.concat(rest, F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substring(tail, F.lit(1), hi % CHUNK_CHARS))
            return F.when(first == last, here).otherwise(between)

        reach = _before(F.transform(spans, lambda x: x["end"]), _larger)
        new = F.zip_with(spans, reach, lambda x, r: F.when(x["start"] >= r, F.concat(part(r, x["start"]), F.lit(replacement))).otherwise(F.lit("")))
        return F.concat(F.array_join(new, ""), part(F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text)))

    cut = _once(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK_CHARS), F.lit(0)), rewritten)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(text)).drop(at)
