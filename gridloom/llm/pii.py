r"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers: the
seeds. Patterns are the words at one to four places before a seed, pairs of words, the word behind, the
label of its line, and its own shape. Patterns and the instances they go with form a graph. Patterns
are scored by their instances and unlabelled instances by their patterns, in turns; a fifth of the
seeds is hidden meanwhile and sets the confidence from which patterns are trusted. Trusted patterns
name unseen identifiers; these count as seeds for new patterns, until no pattern is added. Their
spans are added, base spans always stay.

A regular expression marks matches with two control characters; the lengths of what lies between
give positions in code points. A text's own such characters count as U+0003, which no pattern takes.

Null and empty texts have no spans. Rows with equal or null ids each give a row. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import scratch

KINDS = ("email", "ip", "card", "phone")
_IN, _OUT, _STAND_IN = "\x01", "\x02", "\x03"
# Starts are tied to where a run of the first class starts or the last match ended: elsewhere a
# match would have begun earlier. Possessive repeats give the same matches as greedy ones here.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that could be identifiers: non-white-space with a digit or @.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What follows a label written together with it.
_LABELLED = r"(?<=:)(?<=(?<!\S)[A-Za-z]{1,32}:)[^\s0-9@]*+[0-9@]\S*+"
#: Numbers of several groups with single blanks between, which may begin behind a label.
_RUN = r"(?=[+(0-9])(?:(?<!\S)|(?<=:)(?<=(?<!\S)[A-Za-z]{1,32}:))[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++(?![^\s,;:!?\"'>\]])"
#: Places in the order of candidates: tokens, what follows labels, runs, tokens inside a run (not counted for scores).
_AS_TOKEN, _AS_LABELLED, _AS_RUN, _INSIDE = range(len(KINDS), len(KINDS) + 4)
#: Brackets and punctuation around a candidate; a bracket that encloses only a number's first group stays.
_LEAD, _TRAIL = r"^(?:[\"'<\[]|\((?!\+?[0-9]{1,6}\)[\x20-]?[(0-9]))+", r"[\"')>\],;:.!?]+$"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
#: What an unseen identifier of a kind has to look like; cards also have to pass Luhn's test.
_PLAUSIBLE = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[ .-]*[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9][0-9(). -]{5,}[0-9]$",
}
#: Rounds of scoring, and the least number of a pattern's seeds.
ROUNDS, SUPPORT = 2, 5
#: Confidences that patterns may be trusted from, and the share of hidden seeds they must name rightly.
LEVELS, PRECISION = (0.7, 0.8, 0.9, 0.95), 0.95
#: The confidence where there are too few seeds for any hidden one to be named.
UNTESTED = 0.85
#: An unlabelled instance without any evidence counts this much against a pattern.
DOUBT = 0.5
#: Pieces that a common pattern's or instance's edges are cut into before they are joined.
SALTS = 16
_STEP = 512


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Sums of all elements before each, in blocks so that long arrays don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def block(b: Column) -> Column:
        base = total(F.slice(lengths, F.lit(1), b * _STEP))
        own = F.struct(base.alias("base"), F.slice(lengths, b * _STEP + 1, F.lit(_STEP)).alias("own"))
        return _let(own, lambda s: F.transform(s["own"], lambda _, i: s["base"] + total(F.slice(s["own"], F.lit(1), i))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")), block))


def matches(text: Column, pattern: str, order: int, kind: str | None, needs: Column | None = None) -> Column:
    """Array of (start, ord, kind, end, value): the pattern's leftmost matches, not overlapping. Texts without what it ``needs`` have none."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_IN}$0{_OUT}")), _IN, -1)

    def spans(split: Column) -> Column:
        # the first part is what lies before the first match
        offsets = _running(F.transform(split, lambda s: s["n"]))
        made = F.zip_with(
            split,
            offsets,
            lambda s, at: F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(kind).cast("string").alias("kind"), (at + F.length(s["value"])).alias("end"), s["value"].alias("value")),
        )
        return F.slice(made, F.lit(2), F.size(split) - 1)

    def measured(parts: Column) -> Column:
        sized = F.transform(parts, lambda p: F.struct(F.substring_index(p, _OUT, 1).alias("value"), F.length(F.replace(p, F.lit(_OUT), F.lit(""))).cast("long").alias("n")))
        return F.when(F.size(parts) > 1, _let(sized, spans)).otherwise(F.array().cast(_SPANS))

    found = _let(pieces, measured)
    return found if needs is None else F.when(needs, found).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:bigint,ord:int,kind:string,end:bigint,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)

    def weigh(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.regexp_like(v, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _context(text: Column, spans: Column) -> Column:
    """Each span with its lexical patterns: words before at one to four places, pairs of them, the word behind, the line's label, the shape."""

    def around(s: Column) -> Column:
        left = F.lower(F.substring(text, F.greatest(s["start"] - 79, F.lit(1)).cast("int"), F.least(s["start"], F.lit(80)).cast("int")))
        left = F.regexp_replace(left, r"(?<!\S)([a-z]{1,32}:)(\S{0,1})$", "$1 $2")  # a label is a word of its own
        right = F.lower(F.substring(text, (s["end"] + 1).cast("int"), F.lit(60)))
        shape = F.regexp_replace(F.translate(F.lower(_bare(s["value"])), "0123456789", "9" * 10), r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "a")
        after, label = F.regexp_extract(right, r"^\S{0,1}[ \t]+(\S+)", 1), F.regexp_extract(left, r"([^\s:]+):[^:\n]*+$", 1)

        def named(w: Column) -> Column:
            # w: words before, the nearest first
            word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
            pair = F.when(F.size(w) > 1, F.concat(word(1), F.lit(" "), word(0))).otherwise("")
            parts = [("1 ", word(0)), ("2 ", pair), ("3 ", word(1)), ("4 ", word(2)), ("5 ", word(3)), ("+ ", after), ("^ ", label), ("# ", shape)]
            return F.filter(F.array(*(F.concat(F.lit(k), v) for k, v in parts)), lambda x: F.length(x) > 2)

        line = F.regexp_replace(F.substring_index(left, "\n", -1), r"(?<!\s)\S$", "")
        before = F.filter(F.split(F.regexp_replace(line, r"\S$", ""), r"[ \t]+"), lambda x: F.length(x) > 0)
        patterns = _let(F.reverse(before), named)
        return F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), patterns.alias("patterns"))

    return F.transform(spans, around)


def extract(df: DataFrame, hide: Callable[[Column], Column] | None = None) -> DataFrame:
    """row, doc_id, base (valid base spans with contexts), tokens (identifier-like rest with contexts: tokens, labelled ones, runs).

    Base spans that ``hide`` picks are among the tokens, as if no base pattern had found them.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(F.regexp_like(raw, F.lit(f"[{_IN}{_OUT}]")), F.translate(raw, _IN + _OUT, _STAND_IN * 2)).otherwise(raw)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("digits", F.regexp_like("text", F.lit("[0-9]"))).withColumn("at", F.contains("text", F.lit("@")))
    needs = {"email": F.col("at"), "ip": F.col("digits"), "card": F.col("digits"), "phone": F.col("digits") & F.contains("text", F.lit("+"))}

    def valid(order: int, kind: str) -> Column:
        return F.filter(matches(F.col("text"), _BASE[kind], order, kind, needs[kind]), lambda s: _VALID[kind](s["value"]))

    docs = docs.withColumn("base", F.array_sort(F.concat(*(valid(i, k) for i, k in enumerate(KINDS)))))
    clear = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    runs = F.filter(matches(F.col("text"), _RUN, _AS_RUN, None, F.col("digits")), lambda s: F.length(_digits(s["value"])).between(7, 19))
    docs = docs.withColumn("runs", F.filter(runs, clear))
    inside = lambda t: F.exists("runs", lambda r: (r["start"] <= t["start"]) & (t["start"] < r["end"]))
    place = lambda t: t.withField("ord", F.when(inside(t), _INSIDE).otherwise(t["ord"]))
    either = F.col("digits") | F.col("at")
    single = F.concat(matches(F.col("text"), _TOKEN, _AS_TOKEN, None, either), matches(F.col("text"), _LABELLED, _AS_LABELLED, None, either & F.contains("text", F.lit(":"))))
    docs = docs.withColumn("tokens", F.concat(F.transform(F.filter(single, clear), place), "runs"))
    if hide is not None:
        unseen = lambda s: s.withField("kind", F.lit(None).cast("string")).withField("ord", F.lit(_AS_TOKEN))
        docs = docs.withColumn("tokens", F.concat("tokens", F.transform(F.filter("base", hide), unseen))).withColumn("base", F.filter("base", lambda s: ~hide(s)))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _context(F.col("text"), F.col("base")).alias("base"), _context(F.col("text"), F.col("tokens")).alias("tokens"))


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, f"{_LEAD}|{_TRAIL}", "")


def _plausible(kind: str, value: Column) -> Column:
    fits = F.regexp_like(value, F.lit(_PLAUSIBLE[kind]))
    return fits & F.when(fits, _luhn(value)).otherwise(False) if kind == "card" else fits


def _kinds(value: Column) -> Column:
    """The kinds that an unseen value may be of."""
    return F.filter(F.array(*(F.when(_plausible(k, value), F.lit(k)) for k in KINDS)), lambda k: k.isNotNull())


def _salted(df: DataFrame, column: str) -> DataFrame:
    """Edges with the piece of their pattern's or instance's edges that they are in."""
    return df.withColumn("salt", F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int"))


def _for_all_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def confident_patterns(spans: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, level: float | None = None) -> DataFrame:
    """(pattern, found_kind) whose instances are mostly of that kind. ``spans``: kind, value, patterns of all occurrences.

    A pattern's confidence is the sum of its distinct instances' scores over their number; seeds of
    the kind score 1, unlabelled ones that can't be of the kind 0, others that at least one of their
    patterns is right, and they count as DOUBT at least. The confidence that patterns need is the least of LEVELS at
    which they name hidden seeds with PRECISION. Then instances of trusted patterns count as seeds with
    their pattern's confidence as score, until no pattern is added.
    """
    instance = F.lower("value")
    edges = spans.select(F.explode("patterns").alias("pattern"), instance.alias("instance"), "kind")
    edges = edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    hidden = F.col("kind").isNotNull() & (F.pmod(F.xxhash64("instance", F.lit(5)), F.lit(5)) == 0)
    could = F.when(F.col("kind").isNull(), _kinds(_bare(F.col("instance")))).otherwise(F.array("kind"))
    edges = scratch(edges.select("pattern", "instance", "kind", hidden.alias("hidden"), could.alias("could")), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))

    def score(seeds: DataFrame, unsure: DataFrame, known: DataFrame | None) -> DataFrame:
        """Confidence by pattern and kind. seeds, unsure: (pattern, instance, kind); known: (instance, kind, score, seed)."""
        votes = seeds.select("pattern", "kind", F.lit(1.0).alias("good"), F.lit(1.0).alias("weight"), F.lit(1).alias("seed"))
        rest = unsure.select("pattern", "kind", F.lit(0.0).alias("good"), F.lit(DOUBT).alias("weight"), F.lit(0).alias("seed"))
        if known is not None:
            met = _salted(unsure, "pattern").join(_for_all_salts(known), ["instance", "kind", "salt"], "left")
            s = F.coalesce("score", F.lit(0.0))
            rest = met.select("pattern", "kind", s.alias("good"), F.greatest(s, F.lit(DOUBT)).alias("weight"), F.coalesce("seed", F.lit(0)).alias("seed"))
        sums = votes.union(rest).groupBy("pattern", "kind").agg(F.sum("good").alias("good"), F.sum("weight").alias("weight"), F.sum("seed").alias("seeds"), F.count("*").alias("n"))
        rated = sums.where(F.col("seeds") >= support).join(totals, "pattern")
        return rated.select("pattern", "kind", (F.col("good") / (F.col("total") - F.col("n") + F.col("weight") + 1)).alias("conf"))

    def reached(unsure: DataFrame, patterns: DataFrame) -> DataFrame:
        return _salted(unsure, "instance").join(_for_all_salts(patterns), ["pattern", "kind", "salt"])

    def in_rounds(seeds: DataFrame, unsure: DataFrame) -> DataFrame:
        patterns = score(seeds, unsure, None)
        for _ in range(rounds - 1):
            likely = reached(unsure, patterns.where("conf >= 0.5")).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("score"))
            patterns = score(seeds, unsure, likely.withColumn("seed", F.lit(0)))
        return patterns

    seeds = edges.where(F.col("kind").isNotNull()).select("pattern", "instance", "kind")
    unsure = edges.where(F.col("kind").isNull()).select("pattern", "instance", F.explode("could").alias("kind"))
    if level is None:
        level = _level(edges, seeds, unsure, in_rounds, reached)
    good = scratch(in_rounds(seeds, unsure).where(F.col("conf") >= level), "pii-patterns")
    more = good
    while not more.isEmpty():
        found = reached(unsure, good).groupBy("instance", "kind").agg(F.max("conf").alias("score"))
        rated = score(seeds, unsure, found.withColumn("seed", F.lit(1))).where(F.col("conf") >= level)
        more = scratch(rated.join(good, ["pattern", "kind"], "left_anti"), "pii-patterns")
        good = good.unionByName(more)
    return good.groupBy("pattern").agg(F.max(F.struct("conf", "kind"))["kind"].alias("found_kind"))


def _level(edges: DataFrame, seeds: DataFrame, unsure: DataFrame, in_rounds, reached) -> float:
    """The least of LEVELS at which patterns of the other seeds name hidden seeds with PRECISION, the highest if at none they do."""
    shown = edges.where(F.col("kind").isNotNull() & ~F.col("hidden")).select("pattern", "instance", "kind")
    out = edges.where("hidden").select("pattern", "instance", F.col("kind").alias("truth"))
    # a hidden seed may be of any kind that its looks allow, and of its own
    asked = out.select("pattern", "instance", F.explode(F.array_union(_kinds(_bare(F.col("instance"))), F.array("truth"))).alias("kind"), "truth")
    patterns = in_rounds(shown, unsure.unionByName(asked.drop("truth")))
    named = reached(asked, patterns.where(F.col("conf") >= min(LEVELS))).groupBy("instance", "truth", "kind").agg(F.max("conf").alias("conf"))
    right = [F.sum(F.when((F.col("conf") >= x) & (F.col("kind") == F.col("truth")), 1).otherwise(0)).alias(f"r{i}") for i, x in enumerate(LEVELS)]
    every = [F.sum(F.when(F.col("conf") >= x, 1).otherwise(0)).alias(f"n{i}") for i, x in enumerate(LEVELS)]
    got = named.agg(*right, *every).first()
    if not got["n0"]:
        return UNTESTED
    return next((x for i, x in enumerate(LEVELS) if got[f"n{i}"] and got[f"r{i}"] >= PRECISION * got[f"n{i}"]), max(LEVELS))


def find_pii(df: DataFrame, hide: Callable[[Column], Column] | None = None) -> DataFrame:
    """row, doc_id, base, found: arrays of (start, ord, kind, end); ``found`` also holds what patterns add."""
    spans = scratch(extract(df, hide), "pii-spans")
    occurrences = spans.select("row", F.explode(F.concat("base", "tokens")).alias("s")).select("row", "s.*")
    good = confident_patterns(occurrences.where(F.col("ord") < _INSIDE).select("kind", "value", "patterns"))
    value = _bare(F.col("value"))
    skipped = F.length(F.regexp_extract("value", _LEAD, 0))
    unseen = occurrences.where(F.col("kind").isNull()).select("row", (F.col("start") + skipped).alias("start"), value.alias("value"), "patterns")
    unseen = unseen.withColumn("could", _kinds(F.col("value"))).where(F.size("could") > 0).select("row", "start", "value", "could", F.explode("patterns").alias("pattern"))
    named = _salted(unseen, "row").join(_for_all_salts(good), ["pattern", "salt"])
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("found_kind")).cast("int") - 1
    chosen = named.where(F.array_contains("could", F.col("found_kind"))).groupBy("row", "start", "value").agg(F.min("found_kind").alias("found_kind"))
    # of candidates within each other the longest stays
    chosen = chosen.withColumn("end", F.col("start") + F.length("value"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("reached", F.max("end").over(before)).where(F.col("reached").isNull() | (F.col("end") > F.col("reached")))
    added = chosen.select("row", F.struct("start", order.alias("ord"), F.col("found_kind").alias("kind"), "end").alias("s")).groupBy("row").agg(F.collect_list("s").alias("added"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end")))
    joined = spans.select("row", "doc_id", plain.alias("base")).join(added, "row", "left")
    return joined.select("row", "doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("found"))


def pii_report(df: DataFrame) -> DataFrame:
    """The digest columns: counts and sha256 of base spans, and all spans as text."""
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(df).select("doc_id", *map(count, KINDS), F.sha2(join("base"), 256).alias("base_sha256"), join("found").alias("spans"))
