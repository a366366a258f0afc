"""Pairs of close names of a block, formed from what they share instead of from all pairs.

A name is taken as the bag of its padded letter pairs, which does not depend on the order of its
words. An edit changes few of them, so two names that reach a floor must share a number of letter
pairs that follows from their lengths: the bounds are in :func:`_needed`. Letter pairs are ranked by
how rare they are in the block. Names that must share ``n`` of their ``g`` letter pairs share at least
``k`` of their rarest ``g - n + k``, so every name is listed under each choice of ``k`` of these, and
names meet only under the rarest choice that they share. ``k`` is chosen per block by the rows it
would make: none for a block of a few names, which all meet, and more where single letter pairs are
common to too many. Nothing is left out: the bounds hold for every way in which a score can reach the
floor, and names too short or floors too low for a bound (under two thirds) meet all of their block.

Where only the best match of each name is asked for, names of one length that differ in one letter
are not paired at all: they meet under what is left without that letter, and a window finds the best
of each such group. What is looked for after that meets only names that can still be preferred.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import (
    FAR_PART_ABOVE,
    FAR_PART_WEIGHT,
    PART_FROM,
    PART_WEIGHT,
    WORD_WEIGHT,
    edit_similarity,
    may_reach,
    similarity,
    unshared,
    word_key,
)
from ..session import broadcast_if_small, settle

# Letter pairs are counted in so many groups per block; a group's count ranks its members.
GROUPS = 512
# Letter pairs in a choice, and most choices that a name is listed under.
TOGETHER, MOST_CHOICES = (0, 1, 2, 3, 4, 6, 8), 512
# A block whose names all meet is cut into parts of about so many; each two parts meet in a tile of their own.
PART_NAMES = 512
# What a row under a choice costs, in pairs of names that meet.
LISTING = 1
# A score prints with two decimals; what prints alike must be found at one floor.
LAST_DIGIT = 0.01
# Floors tried before the one asked for, where a block has more names than this.
FALLING, LARGE = (100 * WORD_WEIGHT, 90.0, 85.0), 1024
# At this length and above, a letter changed scores higher than all that scores less than equal words and has more edits.
LETTER_FROM = 13
NEAR, FAR = 0, 1
NAMED = ("normalized_value", "original_value", "frequency")
# All that parts words.
_SPACE = r"(?U)[\s\x1c-\x1f\x85]"


def _kinds(entries: str) -> Column:
    """Numbers of sorted entries; the second of a kind is another one than the first."""
    return F.transform(entries, lambda entry, at: F.xxhash64(entry, at - F.array_position(entries, entry)))


def _bits(kinds: Column, part: int, size: int) -> Column:
    """The kinds that fall to a part of so many bits as bits of a number; where two names' bits differ, so do their kinds."""

    def bit(x: Column) -> Column:
        place = F.pmod(x, F.lit(size)).cast("int")
        return F.when(F.shiftright(place, 6) == part, F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(kinds, F.lit(0).cast("long"), lambda all_, x: all_.bitwiseOR(bit(x)))


def _listed_in_blocks(names: DataFrame, block_keys: Callable[[Column], Column]) -> DataFrame:
    """Each name under its blocks, with its letter pairs.

    The keys are those for the beginning, the first word and the initials. A pair counts in the
    first key that its names share, so later blocks have the earlier keys along.
    """
    plain = F.regexp_replace("normalized_value", _SPACE, " ")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(plain) + 1), lambda at: F.substring(padded, at, F.lit(2)))
    named = names.select(
        *NAMED,
        block_keys(F.col("normalized_value")).alias("keys"),
        F.char_length("normalized_value").alias("length"),
        # Words that repeat count once in some of the scores.
        F.char_length(F.array_join(F.array_distinct(words), " ")).alias("once_length"),
        F.array_sort(grams).alias("grams"),
        F.array_sort(F.transform(F.sequence(F.lit(1), F.char_length(plain)), lambda at: F.substring(plain, at, F.lit(1)))).alias("characters"),
        (F.array_join(F.array_distinct(words), " ") == F.col("normalized_value")).alias("is_plain"),
    )
    kinds = {"letters": F.array_distinct(_kinds("grams")), "singles": _kinds("characters")}
    return named.withColumns(kinds).select("*", F.posexplode("keys").alias("place", "block")).select(
        "block",
        "place",
        *[F.when(F.col("place") > k, F.get("keys", F.lit(k))).alias(f"earlier_{k}") for k in (0, 1)],
        *NAMED,
        "length",
        "once_length",
        "is_plain",
        "letters",
        *[_bits(F.col("letters"), k, 128).alias(f"bits_{k}") for k in (0, 1)],
        _bits(F.col("singles"), 0, 64).alias("bits_2"),
    )


def _with_facts(members: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Members with what is known of their blocks; where these are few, not even a large block is gathered in one task."""
    return members.join(broadcast_if_small(facts)[0], by)


def ranked(names: DataFrame, block_keys: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """Names in blocks that can bring new pairs, and whether some block is large.

    If one is, letter pairs are put in order, from the rarest in the block to the most common; else
    all names of a block will meet and the order does not matter.
    """
    members = settle(_listed_in_blocks(names, block_keys))
    several = [F.coalesce(F.min(f"earlier_{k}") != F.max(f"earlier_{k}"), F.col("place") <= k) for k in (0, 1)]
    sizes = members.groupBy("block", "place").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("length").alias("least"),
        F.max("length").alias("most"),
        F.min("once_length").alias("once_least"),
        F.max("once_length").alias("once_most"),
        F.bool_and("is_plain").alias("all_plain"),
        (several[0] & several[1]).alias("new"),
    )
    sizes = broadcast_if_small(sizes.filter("size > 1 AND new").drop("place", "new"))[0]
    known = members.join(sizes, "block")
    if sizes.filter(F.col("size") > LARGE).isEmpty():
        return known, False
    group = F.pmod(F.col("letter"), F.lit(GROUPS)).cast("int")
    counted = known.select("block", F.explode("letters").alias("letter")).groupBy("block", group.alias("group")).agg(F.count(F.lit(1)).alias("n"))
    # A small map per block.
    counts = counted.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("group", "n"))).alias("counts"))
    by_rank = F.array_sort(
        F.transform("letters", lambda letter: F.struct(F.element_at("counts", F.pmod(letter, F.lit(GROUPS)).cast("int")).alias("n"), letter.alias("letter")))
    )
    found = _with_facts(known, counts, ["block"]).withColumn("by_rank", by_rank)
    found = found.withColumn("letters", F.transform("by_rank", lambda e: e["letter"]))
    found = found.withColumn("shares", F.transform("by_rank", lambda e: (e["n"] / F.col("size")).cast("float")))
    return settle(found.drop("by_rank", "counts")), True


def _needed(kind: int, metric: str, floor: float, mine: Column, theirs: Column, plain: Column) -> Column:
    """Letter pairs that names of these lengths (repeated words once) share if they reach the floor, or fewer.

    Of a string of n letters there are n + 1 padded letter pairs. A letter put in takes one away, a
    letter taken out two, so strings of T letters together at an indel distance of d share at least
    1 + T / 2 - 1.5 d; sorting words changes none, and words that both have share all of theirs. With a
    score s the distance is at most (1 - s) T, and it is odd or even as the difference of the lengths
    is (``plain``: no word repeats, so the lengths are those of the strings). If the words that both
    have make the score, they are at least s / (2 - s) of the shorter name. An edit takes away two
    letter pairs. Where one name is far longer, the score comes from a part of it, at least s / (2 - s)
    as long as the other name and not padded, or from any word that both have.
    """
    s = floor / 100
    if metric == "edit":
        return 1 + F.greatest(mine, theirs) * (2 * s - 1) if s > 0.5 else F.lit(0.0)
    if kind == NEAR:
        if 1.5 * s <= 1:
            return F.lit(0.0)
        total = mine + theirs
        whole = F.floor(total * (1 - s) + 1e-9)
        apart = F.when(plain, whole - F.pmod(whole - mine + theirs, F.lit(2))).otherwise(total * (1 - s))
        words = min(s / WORD_WEIGHT, 1.0)
        return F.least(1 + total / 2 - 1.5 * apart, 1 + F.least(mine, theirs) * (words / (2 - words)))
    part = min(s / PART_WEIGHT, 1.0)
    if 1.5 * part <= 1:
        return F.lit(0.0)
    inside = F.least(mine, theirs) * (1 + part / (2 - part)) * (1.5 * part - 1) - 1
    return F.least(inside, F.lit(2.0)) if s <= WORD_WEIGHT * PART_WEIGHT else inside


def _apart(floor: float, mine: Column, theirs: Column) -> Column:
    """Most characters that one of two plain names has and the other has not, if their lengths are near and they reach the floor.

    No more than their indel distance, or than what is not among the words that both have.
    """
    s = floor / 100
    words = min(s / WORD_WEIGHT, 1.0)
    total = mine + theirs
    return F.greatest(total * (1 - s), total - F.least(mine, theirs) * (2 * words / (2 - words))) + 1e-9


def _whole(needed: Column) -> Column:
    return F.greatest(F.ceil(needed - 1e-9), F.lit(0)).cast("int")


def _tile(part: Column, other: Column) -> Column:
    return F.xxhash64(F.least(part, other), F.greatest(part, other))


def _choices(together: int) -> str:
    """SQL for all choices of so many of the ``first`` letter pairs, as a number and the place of the last; tiles where no choice is made.

    Long expressions are written as SQL: a call for each of their parts would take longer than small tables do.
    """
    if together == 0:
        return "transform(sequence(0, parts - 1), other -> struct(xxhash64(least(part, other), greatest(part, other)) AS number, 0 AS last))"
    found = "transform(first, (x, at) -> struct(xxhash64(0L, x) AS number, at AS at))"
    for _ in range(together - 1):
        later = "slice(first, c.at + 2, greatest(size(first) - c.at - 1, 0))"
        longer = f"transform({later}, (x, k) -> struct(xxhash64(c.number, x) AS number, c.at + k + 1 AS at))"
        found = f"flatten(transform({found}, c -> {longer}))"
    return f"transform({found}, c -> struct(c.number AS number, c.at + 1 AS last))"


def _rarest(k: int | str) -> str:
    """SQL for how many of the rarest letter pairs of a name choices of k are made from."""
    return f"greatest(least(size(letters), size(letters) - need + {k}), 0)"


def _cost(k: int) -> str:
    """SQL for the rows of a name under choices of k, and the names met there if letter pairs were independent."""
    ways = " * ".join(["1.0D", *(f"greatest(c - {i}, 0) / {i + 1}" for i in range(k))])
    # The sums of the products of up to k shares.
    none = ", ".join("1D" if i == 0 else "0D" for i in range(k + 1))
    step = "(e, x) -> transform(e, (v, i) -> v + if(i > 0, x * get(e, i - 1), 0D))"
    met = f"size * get(aggregate(slice(shares, 1, c), array({none}), {step}), {k})"
    listings = "parts" if k == 0 else ways
    # Choices are out of the question if they are too many, or if close names need not share one.
    worth = f"if(need < {k} OR {ways} > {MOST_CHOICES}, double('Infinity'), {listings} * {LISTING} + {met})"
    return worth.replace("(c - ", f"({_rarest(k)} - ").replace("1, c)", f"1, {_rarest(k)})")


def listed(members: DataFrame, large: bool, floor: float, metric: str = "weighted") -> DataFrame:
    """:func:`ranked` members under the numbers of their choices, by ``block, kind, choice``.

    What a name is listed by is stored, the rows under its choices are not.
    """
    has_far = (F.col("most") >= PART_FROM * F.col("length")) | (F.col("length") >= PART_FROM * F.col("least"))
    kinds = [(NEAR, members)]
    if floor <= 100 * PART_WEIGHT:
        kinds.append((FAR, members.filter(has_far)))

    def least_needed(kind: int) -> Column:
        """With any partner of the block; a block has names of a few lengths."""
        lengths = F.sequence("once_least", F.greatest("once_most", "once_least"))
        return F.array_min(F.transform(lengths, lambda n: _whole(_needed(kind, metric, floor, F.col("once_length"), n, F.col("all_plain")))))

    rows = reduce(DataFrame.unionByName, [part.withColumns({"kind": F.lit(kind), "need": least_needed(kind)}) for kind, part in kinds])
    rows = rows.withColumn("parts", F.ceil(F.col("size") / PART_NAMES).cast("int")).withColumn("part", F.pmod(F.xxhash64("normalized_value"), F.col("parts")).cast("int"))
    every = TOGETHER if large else (0,)
    if large:
        costs = rows.groupBy("block", "kind").agg(*[F.expr(f"sum({_cost(k)})").alias(f"cost_{k}") for k in every])
        least = "least(" + ", ".join(f"cost_{k}" for k in every) + ")"
        together = "CASE " + " ".join(f"WHEN cost_{k} = {least} THEN {k}" for k in every) + " END"
        rows = _with_facts(rows, costs.select("block", "kind", F.expr(together).alias("together")), ["block", "kind"])
        rows = rows.withColumn("rarest", F.expr(_rarest("together")))
        rows = rows.withColumn("first", F.slice("letters", 1, F.col("rarest")))
    else:
        rows = rows.withColumns({"together": F.lit(0), "rarest": F.lit(0)})
    rows = rows.drop("shares", "size", "least", "most", "once_least", "once_most", "once_length", "all_plain", "place")
    choices = "CASE " + " ".join(f"WHEN together = {k} THEN {_choices(k)}" for k in every) + " END"
    made = (settle(rows) if large else rows).withColumn("made", F.explode(F.expr(choices)))
    return made.select("*", F.col("made.number").alias("choice"), "made.last").drop("made", "first", "parts")


def _both(name: str) -> tuple[Column, Column]:
    return F.col(f"l.{name}"), F.col(f"r.{name}")


def _meet(floor: float, metric: str) -> Column:
    """Whether two listed names meet here, and nowhere before, and may share what the floor needs.

    Kept short: a join's condition is one method of generated code, and long methods are not compiled to machine code.
    """
    same = reduce(lambda x, y: x & y, [a == b for a, b in map(_both, ("block", "kind", "choice"))])
    new = reduce(lambda x, y: x & y, [F.coalesce(a != b, F.lit(True)) for a, b in map(_both, ("earlier_0", "earlier_1"))])
    (m, n), (a, b), q = _both("length"), _both("letters"), F.col("r.rarest")
    long, short = F.greatest(m, n), F.least(m, n)
    kind = (long < short * PART_FROM) == (F.col("l.kind") == NEAR)
    if floor > 100 * FAR_PART_WEIGHT:
        # Beyond a ratio of lengths a part counts too little.
        kind &= long <= short * FAR_PART_ABOVE
    differ = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in map(_both, ("bits_0", "bits_1"))])
    enough = differ <= F.size(a) + F.size(b) - 2 * F.greatest(*_both("need"))
    plain, singles = _both("is_plain"), F.bit_count(_both("bits_2")[0].bitwiseXOR(_both("bits_2")[1]))
    if metric == "weighted":
        enough &= (F.col("l.kind") != NEAR) | ~plain[0] | ~plain[1] | (singles <= _apart(floor, m, n))
    # Names meet under the rarest choice if up to its last letter pair they share no others.
    together = F.col("l.together")
    shared = F.size(F.array_intersect(F.slice(a, 1, F.col("l.last")), F.slice(b, 1, q)))
    rarest = F.when(together == 0, _tile(*_both("part")) == F.col("l.choice")).otherwise(shared == together)
    return same & kind & enough & new & rarest


def _scored(pairs: DataFrame, floor: float, metric: str) -> DataFrame:
    left, right = F.col("left_normalized_value"), F.col("right_normalized_value")
    if metric == "weighted":
        # Dealt again, so that one name with many close ones is scored by many tasks. The random number
        # keeps the filter here, apart from the join, which would be slow with so long a condition; passing
        # the filter by chance does no harm.
        parts = unshared(left, right)
        pairs = pairs.repartition(left, right).withColumns(parts)
        reach = may_reach(left, right, word_key(left), word_key(right), floor, {c: F.col(c) for c in parts})
        pairs = pairs.filter(reach | (F.rand(0) < 1e-18)).drop(*parts)
    score = {"weighted": similarity, "edit": edit_similarity}[metric](left, right)
    return pairs.withColumn("score", score).filter(F.col("score") >= floor)


def _named(first: str, second: str) -> list[Column]:
    return [F.col(f"{side}.{name}").alias(f"{label}_{name}") for side, label in ((first, "left"), (second, "right")) for name in NAMED]


def close_pairs(names: DataFrame, block_keys: Callable[[Column], Column], floor: float, metric: str) -> DataFrame:
    """All pairs of names of a block that reach the floor, with both names' spelling and count."""
    rows = listed(*ranked(names, block_keys), floor, metric)
    a, b = _both("normalized_value")
    pairs = rows.alias("l").join(rows.alias("r"), _meet(floor, metric) & (a < b))
    return _scored(pairs.select(*_named("l", "r")), floor, metric)


def _still_wanted(members: DataFrame, open_: DataFrame, weight: Callable[[str, str], Column]) -> DataFrame:
    """Members of blocks with open names, without those that weigh less than each open name of the block: nobody's match."""
    mine = weight("original_value", "frequency")
    lightest = members.join(open_, "normalized_value", "left_semi").groupBy("block").agg(F.min(mine).alias("lightest"))
    kept = _with_facts(members, lightest, ["block"]).filter(mine >= F.col("lightest")).drop("lightest", "size")
    return settle(_with_facts(kept, kept.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), ["block"]))


def _best_by_letter(members: DataFrame, open_: DataFrame, weight: Callable[[str, str], Column], floor: float) -> DataFrame:
    """The best pairs of open names that have no better match than a preferred name with one letter changed or moved.

    To be called for names without a match at the score of equal words. Of L letters these names score
    ``1 - 1 / L``. A letter more or less scores above equal words from ``LETTER_FROM`` on, so open names have no such match;
    two letters more score above them if L + 1 letters do, and a name whose blocks hold such lengths is left open if they do not.
    All else has three edits or more, or a score of words or parts below ``1 - 1 / L``.
    Names of one length with an indel distance of two are equal without one letter each. Such groups are as
    small as the alphabet, and all pairs of a group score alike.
    """
    words = F.lit(WORD_WEIGHT)
    long = members.filter((F.col("length") >= LETTER_FROM) & (1 - 1 / F.col("length") < words))
    name = F.col("normalized_value")
    without = F.transform(F.sequence(F.lit(1), F.col("length")), lambda at: F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.col("length"))))
    listed_ = long.select("block", *NAMED, "length", "most", F.explode(F.array_distinct(without)).alias("rest"))
    group = Window.partitionBy("block", "rest")
    # Of names of one weight none is preferred.
    heavier = group.orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    other = F.struct((-F.col("frequency")).alias("less"), F.col("original_value"), F.col("normalized_value"))
    placed = listed_.withColumn("place", F.dense_rank().over(group.orderBy(weight("original_value", "frequency").desc())))
    met = placed.withColumn("other", F.min(other).over(heavier)).filter("other IS NOT NULL")
    best = met.groupBy(*NAMED, "length").agg(F.min("other").alias("other")).join(open_, "normalized_value", "left_semi")
    longest = members.groupBy("normalized_value").agg(F.max("most").alias("most"))
    best = best.join(longest, "normalized_value").filter((1 - 1 / (F.col("length") + 1) >= words) | (F.col("most") < F.col("length") + 2))
    others = {"normalized_value": F.col("other.normalized_value"), "original_value": F.col("other.original_value"), "frequency": -F.col("other.less")}
    pairs = best.select(*[F.col(n).alias(f"own_{n}") for n in NAMED], *[others[n].alias(f"other_{n}") for n in NAMED])
    return _scored(_in_order(pairs), floor, "weighted")


def _in_order(pairs: DataFrame) -> DataFrame:
    """With the names of a pair as ``left`` and ``right`` in the order of :func:`close_pairs`."""
    a, b = F.col("own_normalized_value"), F.col("other_normalized_value")
    return pairs.withColumns({"left_normalized_value": F.when(a < b, a).otherwise(b), "right_normalized_value": F.when(a < b, b).otherwise(a)})


def best_pairs(names: DataFrame, block_keys: Callable[[Column], Column], weight: Callable[[str, str], Column], floor: float) -> DataFrame:
    """For each name its best pair with a preferred name (a larger ``weight``) of a block, if it reaches the floor.

    Where blocks are large, floors fall: a name that has a match at a high floor, where names must
    share most of what they have, is not looked for at lower ones. ``weight`` orders by frequency first.
    """
    members, large = ranked(names, block_keys)
    found, open_ = [], members

    def close(best: DataFrame) -> tuple[DataFrame, DataFrame]:
        found.append(settle(best))
        done = found[-1].select(F.col("own_normalized_value").alias("normalized_value"))
        left = settle(open_.select("normalized_value").distinct().join(done, "normalized_value", "left_anti"))
        return left, _still_wanted(members, left, weight)

    for level in [f for f in FALLING if large and f > floor] + [floor]:
        at = level if level == floor else level - LAST_DIGIT
        rows = listed(members, large, at)
        mine = rows if not found else rows.join(open_, "normalized_value", "left_semi")
        preferred = weight("l.original_value", "l.frequency") < weight("r.original_value", "r.frequency")
        pairs = mine.alias("l").join(rows.alias("r"), _meet(at, "weighted") & preferred)
        scored = _scored(_in_order(pairs.select(*[F.col(f"{side}.{n}").alias(f"{s}_{n}") for side, s in (("l", "own"), ("r", "other")) for n in NAMED])), at, "weighted")
        first = Window.partitionBy("own_normalized_value").orderBy(F.desc(F.bround("score", 2)), F.desc("other_frequency"), F.asc("other_original_value"), F.asc("other_normalized_value"))
        best = scored.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank").filter(F.col("score") >= level)
        if level == floor:
            found.append(best)
            continue
        open_, members = close(best)
        if level == 100 * WORD_WEIGHT:
            open_, members = close(_best_by_letter(members, open_, weight, floor))
    pairs = reduce(DataFrame.unionByName, found)
    mine_first = F.col("own_normalized_value") == F.col("left_normalized_value")
    return pairs.select(
        *[
            F.when(mine_first if side == "left" else ~mine_first, F.col(f"own_{name}")).otherwise(F.col(f"other_{name}")).alias(f"{side}_{name}")
            for side in ("left", "right")
            for name in NAMED
        ],
        "score",
    )
