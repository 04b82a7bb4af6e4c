"""Line dedup by a segment-partition edit join, in built-in functions only.

Lines are compared trimmed and in lower case. A line of ``MIN_CHARS`` or more goes when an equal line, or one within
``EDITS`` = 2 edits, occurs earlier in the corpus (by document id, hash of the text, line number). With ``short``, a
shorter line that has a word goes when an equal line occurs earlier; without it, shorter lines always stay.

Two lines within two edits, cut into three segments, agree on one of them (pigeonhole). Every distinct line is indexed
under its three segments with its length, and a line probes, for its own length and the one or two below, the few
substrings at which a segment can still stand if the edits before and after it are to suffice. Keys are hashes; lines
travel as hashes. Only the lines that meet another under a key have their texts fetched; pairs pass a parity sketch of
their characters inside the join and are verified with a banded bit-parallel edit distance.

Lines under a crowded key are cut further and further in the same manner, until what the keys leave open is so short
that lines within two edits share a text with two wildcards. Such groups stand for all their pairs, so neither the rows
nor the comparisons grow with the square of a group.

Rows of documents are told apart by their id and the hash of their text. Rows equal in both are one document: what goes
from one goes from each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import fresh_name, row_hash, settle

EDITS, MIN_CHARS = 2, 32
#: Rows of a key up to which its pairs are verified one by one.
HOT = 32
#: Buckets of the set of hashes that pre-selects lines before a join; a broadcast of this many numbers at most.
BUCKETS = 1 << 19
#: A line with more than this part of all repeats is dealt over ``SALTS`` tasks; there are fewer than ``HEAVY`` such lines.
HEAVY, SALTS = 1_000, 64


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def takes_part(line: Column, min_chars: int, short: bool) -> Column:
    """Whether a normal line is compared: by its length or, with ``short``, as soon as it has a letter or digit."""
    long = F.length(line) >= min_chars
    return long | line.rlike(r"[\p{L}\p{N}]") if short else long


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """``doc_id, row, at, h, line``: the lines that take part. Null texts have none; a null id is an id before all others."""
    if min_chars < 3 * (EDITS + 1):
        raise ValueError("lines must be longer than their segments allow edits")
    body = F.col(text)
    split = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_hash(body).alias("row"), F.posexplode(F.split(body, "\n")).alias("at", "raw"))
    part = split.select("doc_id", "row", "at", normal(F.col("raw")).alias("line")).filter(takes_part(F.col("line"), min_chars, short))
    return part.select("doc_id", "row", "at", F.xxhash64("line").bitwiseAND(F.lit(-2)).alias("h"), "line")


def _segments(n: Column) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of the three segments of a line of n characters; later ones are the longer."""
    base, more = F.floor(n / 3), n % 3
    size = [base, base + F.when(more == 2, 1).otherwise(0), base + F.when(more >= 1, 1).otherwise(0)]
    return [(F.lit(1), size[0]), (1 + size[0], size[1]), (1 + size[0] + size[1], size[2])]


#: (segment, length difference, places relative to the segment's own) to probe besides the line's own index keys: the
#: segment's number bounds the edits before it by its number, those after it by what is left of two.
PROBES = [(1, 0, (-1, 1)), (0, 1, (0,)), (1, 1, (0, 1)), (2, 1, (1,)), (0, 2, (0,)), (1, 2, (1,)), (2, 2, (2,))]


def segment_keys(line: Column) -> tuple[list[Column], list[Column]]:
    """Index keys and further probe keys of a line, as hashes of (length, segment number, characters)."""
    n = F.length(line)

    def key(length: Column, i: int, start: Column, size: Column) -> Column:
        return F.xxhash64(length, F.lit(i), F.substring(line, start.cast("int"), size.cast("int")))

    own = _segments(n)
    index = [key(n, i, *own[i]) for i in range(3)]
    probe = []
    for i, less, shifts in PROBES:
        start, size = own[i] if not less else _segments(n - less)[i]
        probe += [key(n - less, i, start + s, size) for s in shifts]
    return index, probe


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def edit_distance(a: Column, b: Column, most: int = EDITS) -> Column:
    """Banded bit-parallel edit distance of two texts; ``most + 1`` where it is larger. Null where either is null.

    Columns run over b. The rows around the diagonal live in one number, a bit per row, as two sets of vertical
    differences (+1 and -1); the band moves down a row with each column. The score follows the band's lowest diagonal
    until that reaches the last row, and the last row from there on.
    """
    w = 2 * most + 3
    mask = (1 << w) - 1
    bit = lambda x: F.lit(x).cast("bigint")
    flip = lambda x: x.bitwiseXOR(bit(mask))
    down = lambda x: F.shiftright(x, 1)
    m, n = F.length(a), F.length(b)
    near = F.abs(m - n) <= most

    def fold(ca: Column, cb: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            def with_eq(eq: Column) -> Column:
                d0 = ((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(bit(mask))
                return _let(d0, with_d0)

            def with_d0(d0: Column) -> Column:
                h = F.struct(s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"]))).alias("p"), d0.bitwiseAND(s["vp"]).alias("n"))
                return _let(h, lambda x: closed(d0, x["p"], x["n"]))

            def closed(d0: Column, hp: Column, hn: Column) -> Column:
                slant = F.when(d0.bitwiseAND(bit(1 << (w - 1))) == 0, 1).otherwise(0)
                # Past the diagonal's end the last row stands one bit higher with each column.
                row = F.expr("1L") * F.when(j < m - most, bit(0)).otherwise(F.call_function("shiftright", bit(1 << (w - 2)), (j - (m - most)).cast("int")))
                flat = F.when(hp.bitwiseAND(row) != 0, 1).when(hn.bitwiseAND(row) != 0, -1).otherwise(0)
                score = s["score"] + F.when(j < m - most, slant).otherwise(flat)
                return F.struct(score.cast("int").alias("score"), hn.bitwiseOR(flip(down(d0).bitwiseOR(hp))).alias("vp"), down(d0).bitwiseAND(hp).alias("vn"))

            c = F.get(cb, j)
            eq = reduce(lambda x, y: x + y, [F.when(F.get(ca, j + (most - (w - 1) + r)) == c, bit(1 << r)).otherwise(bit(0)) for r in range(w)])
            return _let(eq, with_eq)

        start = F.struct(F.lit(most).alias("score"), bit(mask ^ ((1 << (w - most - 1)) - 1)).alias("vp"), bit(0).alias("vn"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["score"]

    both = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    score = _let(both, lambda x: fold(x["a"], x["b"]))
    # Texts shorter than the band have no diagonal to follow.
    tiny = F.least(F.levenshtein(a, b), F.lit(most + 1))
    long = F.when(near, F.least(score, F.lit(most + 1))).otherwise(most + 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.when((m < w) | (n < w), tiny).otherwise(long))


def sketch(line: Column) -> Column:
    """One bit per character class: whether it occurs an odd number of times. An edit turns over two bits at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("bigint"), lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(64)).cast("int"))))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters at which two texts begin alike, by bisection: few comparisons, each of whole substrings."""
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(k: Column, bit: Column) -> Column:
        to = k + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((to <= most) & (F.substring(a, F.lit(1), to) == F.substring(b, F.lit(1), to)), to).otherwise(k)

    return F.aggregate(steps, F.lit(0), step)


def near(a: Column, b: Column) -> Column:
    """Whether two texts lie within ``EDITS`` edits. What they have in common at either end is left out first."""
    cut = lambda x, k: F.substring(x, k + 1, F.length(x))
    ahead = _let(common_prefix(a, b), lambda k: F.struct(F.reverse(cut(a, k)).alias("a"), F.reverse(cut(b, k)).alias("b")))
    rest = _let(ahead, lambda x: _let(common_prefix(x["a"], x["b"]), lambda k: F.struct(cut(x["a"], k).alias("a"), cut(x["b"], k).alias("b"))))
    return _let(rest, lambda x: edit_distance(x["a"], x["b"])) <= EDITS


def candidates(lines: DataFrame) -> DataFrame:
    """``key, mark``: every distinct line under every key under which it meets another. The mark is the line's hash with
    its low bit given up for the flag "index key"."""
    index, probe = segment_keys(F.col("line"))
    names = [f"k{i}" for i in range(len(index) + len(probe))]
    body = lines.select("h", *[k.alias(n) for k, n in zip(index + probe, names, strict=True)])
    once = body.groupBy("h").agg(*[F.first(n).alias(n) for n in names])
    rows = once.select(F.posexplode(F.array(*names)).alias("place", "key"), "h").select("key", (F.col("h") + F.when(F.col("place") < len(index), 1).otherwise(0)).alias("mark"))
    a, b = rows.alias("a"), rows.alias("b")
    # Who meets anybody under a key: no pair is written yet, and both sides are one exchange.
    met = (F.col("a.key") == F.col("b.key")) & (_line_of("a.mark") != _line_of("b.mark")) & (F.col("a.mark").bitwiseOR(F.col("b.mark")).bitwiseAND(F.lit(1)) == 1)
    return settle(a.join(b, met, "left_semi"), "meeting")


def _line_of(mark: str) -> Column:
    return F.col(mark).bitwiseAND(F.lit(-2))


def fetch(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h, line`` of the wanted hashes. A bounded set of hash buckets keeps most lines out of the join."""
    buckets = wanted.select(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).distinct()
    some = lines.select("h", "line").withColumn("bucket", F.pmod("h", F.lit(BUCKETS))).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
    return some.join(wanted, "h").groupBy("h").agg(F.min("line").alias("line"))


def near_links(lines: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Every two different lines (``h``, ``line``) within two edits, in two forms: links ``a, b`` (hashes, a > b), and
    groups ``g, h`` whose members all lie within two edits of each other. A close pair is in one of them at least.

    Under a key with ``hot`` rows or fewer the pairs are verified one by one; lines of crowded keys form groups.
    """
    meeting = candidates(lines)
    texts = settle(fetch(lines, meeting.select(_line_of("mark").alias("h")).distinct()).select("h", "line", F.length("line").alias("size"), sketch(F.col("line")).alias("sketch")), "texts")
    crowded = settle(meeting.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), "crowded")
    calm = meeting.join(crowded, "key", "left_anti").select("key", _line_of("mark").alias("h"), (F.col("mark").bitwiseAND(F.lit(1)) == 1).alias("own"))
    many = meeting.join(crowded, "key", "left_semi").select(_line_of("mark").alias("h")).distinct()
    more, groups = close_groups(settle(many.join(texts, "h").select("h", "line"), "many"), hot)
    calm = reduce(DataFrame.unionByName, [calm, *more])
    known = settle(calm.join(texts.select("h", "size", "sketch"), "h"), "known")
    a, b = known.filter("own").alias("a"), known.alias("b")
    alike = (F.abs(F.col("a.size") - F.col("b.size")) <= EDITS) & (F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) <= 2 * EDITS)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.h") != F.col("b.h")) & alike)
    pairs = pairs.select(F.greatest("a.h", "b.h").alias("a"), F.least("a.h", "b.h").alias("b")).distinct()
    named = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    # Pairs are small and their verification is not: deal them anew over all tasks.
    dealt = named.repartition(_tasks(lines.sparkSession), "a", "b")
    return settle(dealt.filter(near(F.col("line_a"), F.col("line_b"))).select("a", "b"), "links"), groups


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Groups of lines that are all close to each other, without pairs. A text is cut like a line above. If both edits fall
# into one segment, the other two agree and the problem is that of the segment ("inner" keys). If two segments have one
# edit each, the third agrees, and each of the two has one edit: cut in halves, one half agrees ("outer" keys). Both ways
# go on as long as a key has two different members, down to a few characters, where texts with wildcards in all possible
# places say which are close. Every level is a map and a grouping; a group's rows never come together.


def wild(text: Column, key: Column) -> Column:
    """Hashes of a text with one character, or nothing, replaced by a wildcard. Texts share one just when they lie
    within one edit."""
    n = F.length(text)
    cut = lambda p: F.xxhash64(key, F.substring(text, F.lit(1), F.shiftright(p - 1, 1)), F.substring(text, F.shiftright(p, 1) + 1, n))
    return F.transform(F.sequence(F.lit(1), 2 * n + 1), cut)


def wild_twice(text: Column, key: Column) -> Column:
    """The same with two wildcards, for two edits. An even place p is a character, an odd one a gap."""
    n = F.length(text)
    before, after = (lambda p: F.shiftright(p - 1, 1)), (lambda p: F.shiftright(p, 1) + 1)

    def cut(p: Column, q: Column) -> Column:
        return F.xxhash64(key, F.substring(text, F.lit(1), before(p)), F.substring(text, after(p), before(q) - after(p) + 1), F.substring(text, after(q), n))

    last = 2 * n + 1
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), last), lambda p: F.transform(F.sequence(p + (1 - p % 2), last), lambda q: cut(p, q)))))


def _specs(kinds: list[tuple[int, ...]], *names: str) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(k, names, strict=True)]) for k in kinds])).alias("cut")


#: (length difference, kind, shift of the first open part): kinds 0 to 2 leave that segment open, kinds 3 to 5 agree on
#: segment 0 to 2 and leave the two others open, each with one edit.
CUTS = [(d, i, 0) for d in range(EDITS + 1) for i in range(3)] + [(d, i, shift) for d in range(EDITS + 1) for shift in range(max(-1, d - 1), 2) for i in range(3, 6)]


def _cuts(at: DataFrame) -> DataFrame:
    """All inner and outer keys of the texts ``t`` (``n`` characters, from place ``s`` of line ``h``) under the column
    ``key``, with the places that the key leaves open: ``s1, n1`` and, for outer keys, ``s2, n2``, whose texts' hashes
    are ``x, y``. ``own`` marks the cut of the text's own length; the others are those of texts up to two characters
    shorter, and shifted ones. Once a key has settled how much shorter (``d0``), only those follow."""
    c, of = F.col, (lambda *by_kind: F.element_at(F.array(*by_kind), F.col("kind") + 1))
    rows = at.select("*", _specs(CUTS, "d", "kind", "shift")).select("key", "h", "s", "t", "n", "d0", "cut.*").filter("d0 is null or d0 = d").withColumn("less", c("n") - c("d"))
    third, more = F.expr("CAST(less DIV 3 AS INT)"), c("less") % 3
    rows = rows.withColumns({"a": third, "b": third + (more == 2).cast("int"), "c": third + (more >= 1).cast("int")})
    a, b, z, n, shift, zero = c("a"), c("b"), c("c"), c("n"), c("shift"), F.lit(0)
    rest = c("d") - shift
    rows = rows.withColumns(
        {
            "as": of(zero + 1, zero + 1, zero + 1, zero + 1, a + shift + 1, n - z + 1), "an": of(zero, a, a + b, a, b, z), "tail": of(b + z, z, zero, zero, zero, zero),
            "o1": of(zero + 1, a + 1, a + b + 1, a + 1, zero + 1, zero + 1), "n1": of(n - b - z, n - a - z, n - a - b, b + shift, a + shift, a + shift),
            "o2": of(zero, zero, zero, a + b + shift + 1, a + b + shift + 1, a + shift + 1), "n2": of(zero, zero, zero, z + rest, z + rest, b + rest),
        }
    )
    key = F.xxhash64("key", "less", "kind", F.substring("t", c("as"), c("an")), F.substring("t", n - c("tail") + 1, c("tail")))
    rows = rows.select(key.alias("key"), "h", ((c("d") == 0) & (shift == 0)).alias("own"), (c("kind") < 3).alias("inner"), "d", "s", "t", "o1", "n1", "o2", "n2")
    part = lambda i: F.when(~c("inner"), F.xxhash64("key", F.lit(i), F.substring("t", c(f"o{i}"), c(f"n{i}")))).alias("xy"[i - 1])
    return rows.select("key", "h", "own", "inner", "d", (c("s") + c("o1") - 1).alias("s1"), "n1", (c("s") + c("o2") - 1).alias("s2"), "n2", part(1), part(2))


def _halves(state: DataFrame) -> DataFrame:
    """The keys of the texts ``t`` under the column ``key`` for one edit, with the rest that the key leaves open: one half
    agrees; for the text's own length (``own``) and the one below."""
    c, n = F.col, F.length("t")
    rows = state.select("*", _specs([(d, i) for d in (0, 1) for i in (0, 1)], "d", "right")).select("key", "part", "t", "d0", "cut.*").filter((n >= c("d")) & (c("d0").isNull() | (c("d0") == c("d"))))
    rows = rows.withColumn("less", n - c("d")).withColumn("agreed", F.when(c("right") == 0, F.shiftright("less", 1)).otherwise(c("less") - F.shiftright("less", 1)))
    left = c("right") == 0
    key = F.xxhash64("key", "less", "right", F.substring("t", F.when(left, 1).otherwise(n - c("agreed") + 1), c("agreed")))
    rest = F.substring("t", F.when(left, c("agreed") + 1).otherwise(1), n - c("agreed"))
    return rows.select(key.alias("key"), "part", (c("d") == 0).alias("own"), c("d").alias("d0"), rest.alias("t"), (n - c("agreed")).alias("n"))


def _live(rows: DataFrame, member: str, size: str) -> DataFrame:
    """The rows whose key has an own cut and two different members, with the key's number of rows and longest rest."""
    by_key = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(size).alias("most"), F.min(member).alias("low"), F.max(member).alias("high"), F.max("own").alias("met"))
    return settle(rows.join(by_key.filter("low <> high and met").drop("low", "high", "met"), "key"), "live")


def _shared(parts: list[DataFrame], member: str) -> DataFrame:
    """The rows ``g, member`` of all parts, each once, without groups of one."""
    every = settle(reduce(DataFrame.unionByName, parts).distinct(), "groups")
    return every.join(every.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "g", "left_semi").select("g", member)


def close_groups(line: DataFrame, hot: int) -> tuple[list[DataFrame], DataFrame]:
    """Of the lines ``h, line``: rows ``key, h, own`` of keys calm enough for pairs, and groups ``g, h`` of mutually close
    lines."""
    calm, groups, outer = [], [line.select(F.lit(0).cast("bigint").alias("g"), "h").limit(0)], []
    state = line.select(F.lit(0).cast("bigint").alias("key"), "h", F.lit(1).alias("s"), F.length("line").alias("n"), F.lit(None).cast("int").alias("d0"))
    while not state.isEmpty():
        at = state.join(line, "h").select("key", "h", "s", F.substring("line", F.col("s"), F.col("n")).alias("t"), "n", "d0")
        live = _live(_cuts(at), "h", "n1")
        calm.append(live.filter(F.col("rows") <= hot).select("key", "h", "own"))
        full = live.filter(F.col("rows") > hot)
        outer.append(full.filter("not inner").select("key", "h", "x", "y", "s1", "n1", "s2", "n2"))
        inner = full.filter("inner").select("key", "h", F.col("s1").alias("s"), F.col("n1").alias("n"), F.col("d").alias("d0"), "most")
        few = inner.filter("most <= 4").join(line, "h")
        groups.append(few.select("h", F.explode(wild_twice(F.substring("line", F.col("s"), F.col("n")), F.col("key"))).alias("g")))
        state = inner.filter("most > 4").select("key", "h", "s", "n", "d0").distinct()
    if outer:
        parts = reduce(DataFrame.unionByName, outer)
        one = one_edit(parts, line)
        x, y = one.select(F.col("part").alias("x"), F.col("g").alias("gx")), one.select(F.col("part").alias("y"), F.col("g").alias("gy"))
        groups.append(parts.select("h", "x", "y").distinct().join(x, "x").join(y, "y").select("h", F.xxhash64("gx", "gy").alias("g")))
    return calm, settle(_shared(groups, "h"), "groups")


def one_edit(parts: DataFrame, line: DataFrame) -> DataFrame:
    """``g, part``: groups of parts (``x`` and ``y``, hashes that hold their key) that lie within one edit of each other,
    with two different members at least."""
    side = lambda p, s, n, i: parts.select(F.xxhash64("key", F.lit(i)).alias("key"), F.col(p).alias("part"), F.struct("h", F.col(s).alias("s"), F.col(n).alias("n")).alias("at"))
    # The same part stands in many lines: one of them lends its text.
    once = side("x", "s1", "n1", 1).unionByName(side("y", "s2", "n2", 2)).groupBy("key", "part").agg(F.min("at").alias("at"))
    text = F.substring("line", F.col("at.s"), F.col("at.n")).alias("t")
    state = settle(once.withColumn("h", F.col("at.h")).join(line, "h").select("key", "part", text, F.lit(None).cast("int").alias("d0")), "parts")
    found = [state.select(F.col("key").alias("g"), "part").limit(0)]
    while not state.isEmpty():
        live = _live(_halves(state), "part", "n")
        found.append(live.filter("most <= 2").select("part", F.explode(wild(F.col("t"), F.col("key"))).alias("g")))
        state = live.filter("most > 2").select("key", "part", "t", "d0").distinct()
    return _shared(found, "part")


def met_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, row, at, again, near, links``: every place of a line that occurs twice or has a link; whether an equal
    line stands before it, whether a near one does, and to how many different lines it is linked: those verified one by
    one, or those of its largest group of mutually close lines, whichever are more."""
    every = lines_of(docs, doc_id, text, min_chars, short)
    places = settle(every.drop("line"), "places")
    long = every if not short else every.filter(F.length("line") >= min_chars)
    links, groups = near_links(long, hot)
    ends = links.select(F.col("a").alias("h")).unionByName(links.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))
    grouped = groups.select("h").distinct().withColumn("grouped", F.lit(True))
    firsts = places.groupBy("h").agg(F.min(F.struct("doc_id", "row", "at")).alias("first"), F.count("*").alias("n"))
    # What occurs once and has no link is never looked up again.
    firsts = settle(firsts.join(ends, "h", "left").join(grouped, "h", "left").filter("n > 1 or links > 0 or grouped"), "firsts")
    order = firsts.select("h", "first")
    pairs = links.join(order.select(F.col("h").alias("a"), F.col("first").alias("first_a")), "a").join(order.select(F.col("h").alias("b"), F.col("first").alias("first_b")), "b")
    later = pairs.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("h"), F.lit(True).alias("near"), F.lit(0).cast("bigint").alias("mates"))
    members = groups.join(order, "h")
    low = members.groupBy("g").agg(F.min("first").alias("low"), F.count("*").alias("n"))
    classed = members.join(low, "g").select("h", (F.col("first") > F.col("low")).alias("near"), (F.col("n") - 1).alias("mates"))
    later = later.unionByName(classed).groupBy("h").agg(F.max("near").alias("near"), F.max("mates").alias("mates"))
    # The commonest lines, a bounded number, are dealt by their places too: none fills a task.
    total = firsts.agg(F.sum("n").alias("total"))
    hottest = firsts.join(F.broadcast(total), F.col("n") * HEAVY > F.col("total")).select("h", F.lit(True).alias("hot"))
    known = firsts.join(later, "h", "left").join(F.broadcast(hottest), "h", "left")
    n_links = F.greatest(F.coalesce("links", F.lit(0)), F.coalesce("mates", F.lit(0))).alias("links")
    known = known.select("h", "first", F.coalesce("near", F.lit(False)).alias("near"), n_links, F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("salt"))
    dealt = places.join(F.broadcast(hottest), "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "row", "at"), F.lit(SALTS)).cast("int")).otherwise(0))
    return dealt.join(known, ["h", "salt"]).select("doc_id", "row", "at", (F.struct("doc_id", "row", "at") > F.col("first")).alias("again"), "near", "links")


def dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, row, at, near``: every line that goes; near where no equal line stands before it. Rows equal in id and
    text give the same lines more than once."""
    met = met_lines(docs, doc_id, text, min_chars, short, hot)
    return met.filter("again or near").select("doc_id", "row", "at", (~F.col("again")).alias("near"))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document row: its lines, those compared, those that go as equal or as near, those that stay, and the
    number of links to different lines within two edits that its lines have (``met_lines`` says how groups count).

    Null texts have no lines, empty ones have one short line. Rows that share an id (also a null id) are told apart by
    their texts; rows equal in both get the same report. Extra columns are not read.
    """
    met = met_lines(docs, doc_id, text, min_chars, short, hot).groupBy("doc_id", "row", "at").agg(F.max("again").alias("again"), F.max("near").alias("near"), F.max("links").alias("links"))
    gone = met.groupBy("doc_id", "row").agg(F.count_if("again").alias("equal"), F.count_if(F.col("near") & ~F.col("again")).alias("near"), F.sum("links").alias("links"))
    all_lines = F.coalesce(F.split(F.col(text), "\n"), F.array().cast("array<string>"))
    d = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), row_hash(F.col(text)).alias("row"), F.size(all_lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(all_lines, lambda x: takes_part(normal(x), min_chars, short))).cast("bigint").alias("n_compared"),
    )
    out = d.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.row") == F.col("g.row")), "left")
    equal, close, links = (F.coalesce(f"g.{c}", F.lit(0)) for c in ("equal", "near", "links"))
    return out.select("d.doc_id", "d.n_lines", "d.n_compared", equal.alias("n_equal"), close.alias("n_near"), (F.col("d.n_lines") - equal - close).alias("n_kept"), links.alias("n_links"))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short: bool = False, hot: int = HOT) -> DataFrame:
    """The documents with the lines that go taken out of ``text``; all rows and other columns stay, whatever their names.

    A text that loses every line becomes empty. Rows that share an id, or have none, are told apart by their texts.
    """
    of, row, gone = (fresh_name(docs, x) for x in ("of", "row", "gone"))
    lost = dropped(docs, doc_id, text, min_chars, short, hot).groupBy(F.col("doc_id").alias(of), F.col("row").alias(row)).agg(F.collect_set("at").alias(gone))
    joined = docs.join(lost, F.col(doc_id).cast("bigint").eqNullSafe(F.col(of)) & (row_hash(F.col(text)) == F.col(row)), "left")
    lines = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn(text, F.when(F.col(gone).isNull() | F.col(text).isNull(), F.col(text)).otherwise(rest)).select(*docs.columns)
