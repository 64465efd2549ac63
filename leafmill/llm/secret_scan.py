"""Secret scans: character Markov models, by DataFrame functions alone.

Base rules find assignments, access keys and hex strings. Other long runs of key characters are scored by two
first-order Markov models over characters, one of random strings and one of ordinary identifiers; a run's stretches with
a letter in them are secrets where the log-likelihood ratio exceeds ``margin`` a transition. The models are trained from
labelled samples: random strings made by a rule and values that the base rules find, against identifiers made by a rule and different words, from a
bounded sample of ``max_docs`` documents, those of the least hashes. A model is a table of 67 x 67 numbers, smoothed by
kinds of characters and by pairs of letters in either case.

Positions come from splitting the text at the matches: the pieces and the matches between them add up to offsets in
code points.  Defined results: null text is empty, with no spans; repeated rows give equal rows; of a run that overlaps
base spans, each remaining part of 16 characters or more is scored by itself. Extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 16  # characters of a run, of what is left of it, and of a window
MARGIN = 8 / (LEAST - 1)  # eight nats over the transitions of a window
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SEPARATOR = 62  # the last five characters of ALPHABET are separators
# Words that identifiers are made of.
PARTS = """
    address again amount array basic between binary bridge bright budget buffer cache category channel class client
    close column command comment compute config connect context control count country create data delete deploy
    design device direct discount display document double edit encode enough entry equal error event exact execute
    factory file find floor font format forward frame get graph guide handler human image import index internal item
    join judge keep kernel key label language layer left length library line list load logic manager map market
    member memory merge model move name node normal notice number open option order origin owner page parse partner
    path payment people position prefix previous process profile project property public queue read render report
    request response result rule save scope search select sequence server service session set share signal simple
    size source span start state status stop stream string switch symbol table task team text theme thread time
    token tool track tree update usage user value visit visual wait water winter worker wrap write
""".split()


SPANS = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 256  # matches folded into one list


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matched(text: Column, pattern: str, order: int, value: str | None = None) -> Column:
    """Array of (start, order, end) of all matches, in code points; value: a pattern's group 2 of 8 characters at least.

    A fold that appends copies its list at every step, so matches are folded block by block, each from where the blocks
    before it end: the work grows with the matches, and with the square of their blocks alone.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value else hits
    zipped = F.arrays_zip(F.transform(pieces, F.char_length).alias("gap"), F.transform(hits, F.char_length).alias("hit"), F.transform(values, F.char_length).alias("value"))
    size = lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = acc["at"] + size(x)
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        good = x["hit"].isNotNull() & (x["value"] >= 8) if value else x["hit"].isNotNull()
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def blocks(rows: Column) -> Column:
        part = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(part, lambda own: F.struct(own.alias("own"), F.aggregate(own, F.lit(0), lambda n, x: n + size(x)).alias("size")))

    def begun(parts: Column) -> Column:
        """Each block with where it begins."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        at = F.aggregate(parts, start, lambda acc, x: F.struct((acc["at"] + x["size"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.arrays_zip(parts.alias("part"), at.alias("at"))

    def found(block: Column) -> Column:
        start = F.struct(block["at"].alias("at"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(block["part"]["own"], start, step, lambda acc: acc["out"])

    every = let(zipped, lambda rows: let(blocks(rows), lambda parts: F.flatten(F.transform(begun(parts), found))))
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(SPANS))


def made_samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """(value, random): strings from a hash in the shapes of keys, and identifiers put together from words and numbers."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(n)
    code = F.base64(digest)
    plain = F.regexp_replace(code, "[+/=]", "")
    shapes = (F.substring(code, 1, 40), plain, F.substring(F.lower(F.hex(digest)), 1, 40), F.upper(F.substring(plain, 1, 24)))
    keys = F.element_at(F.array(*shapes), (F.col("id") % len(shapes) + 1).cast("int"))
    draw = lambda k, top: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(top))
    every = F.array(*map(F.lit, PARTS))
    many = draw(0, 3) + 2
    words = F.slice(F.array(*[F.element_at(every, (draw(k, len(PARTS)) + 1).cast("int")) for k in range(1, 5)]), F.lit(1), many.cast("int"))
    first, title = F.get(words, F.lit(0)), F.array_join(F.transform(words, F.initcap), "")
    number = F.substring(draw(5, 90000).cast("string"), 1, 5)
    camel = F.concat(first, F.substring(title, F.length(first) + 1, F.length(title)))
    date = F.concat_ws("-", first, (draw(6, 40) + 1990).cast("string"), F.lpad((draw(7, 12) + 1).cast("string"), 2, "0"), F.lpad((draw(8, 28) + 1).cast("string"), 2, "0"))
    joined = lambda by: F.array_join(words, by)
    forms = (joined("_"), camel, F.upper(joined("_")), joined("-"), F.concat(joined("/"), F.lit("/")), F.concat(joined("_"), number), F.concat(title, number), date)
    names = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    return rows.select(keys.alias("value"), F.lit(1).alias("random")).unionByName(rows.select(names.alias("value"), F.lit(0).alias("random")))


def corpus_samples(docs: DataFrame, max_docs: int, max_words: int = 8000) -> DataFrame:
    """(value, random) from a bounded sample: what the base rules find, and different words elsewhere."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    found = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    plain = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), F.lit(r"[A-Za-z][A-Za-z-]{7,}"), F.lit(0))
    keys = texts.select(F.explode(found).alias("value"), F.lit(1).alias("random")).where(F.length("value") >= 16)
    words = texts.select(F.explode(plain).alias("value")).distinct().orderBy(F.xxhash64("value"), "value").limit(max_words)
    return keys.unionByName(words.select("value", F.lit(0).alias("random")))


def smoothed(counts: list[list[float]], own: float = 300.0, letters: float = 600.0) -> list[list[float]]:
    """Transition probabilities from counts of pairs, smoothed in two steps. What a character's own row lacks comes from
    the step between kinds of characters (lower, upper, digit, separator) and a choice within the kind; after a letter,
    that choice is by pairs of letters in either case, smoothed in turn by the letters' frequency. own, letters: how
    many pairs the second and the third source count for."""
    n, case = len(ALPHABET), 26
    kind = [0 if i < case else 1 if i < 2 * case else 2 if i < SEPARATOR else 3 for i in range(n)]
    total = [sum(row[j] for row in counts) + 0.5 for j in range(n)]
    in_kind = [sum(total[j] for j in range(n) if kind[j] == k) for k in range(4)]
    steps = [[0.5] * 4 for _ in range(4)]
    pairs = [[0.0] * case for _ in range(case)]
    for i in range(n):
        for j in range(n):
            steps[kind[i]][kind[j]] += counts[i][j]
            if max(kind[i], kind[j]) < 2:
                pairs[i % case][j % case] += counts[i][j]
    often = [sum(row[j] for row in pairs) + 0.5 for j in range(case)]
    often = [x / sum(often) for x in often]
    near = [[(x + letters * often[j]) / (sum(row) + letters) for j, x in enumerate(row)] for row in pairs]
    out = []
    for i in range(n):
        choice = [near[i % case][j % case] if max(kind[i], kind[j]) < 2 else total[j] / in_kind[kind[j]] for j in range(n)]
        back = [steps[kind[i]][kind[j]] / sum(steps[kind[i]]) * choice[j] for j in range(n)]
        out.append([(counts[i][j] + own * back[j] / sum(back)) / (sum(counts[i]) + own) for j in range(n)])
    return out


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio, random against ordinary, of each transition; a table by first and second character."""
    chars = F.col("value")
    pairs = samples.where(F.length(chars) >= 2).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length(chars) - 1), lambda i: F.substr(chars, i, F.lit(2)))).alias("pair"))
    n = len(ALPHABET)
    counts = [[[0.0] * n for _ in range(n)] for _ in range(2)]
    for r in pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}\z")).groupBy("random", "pair").count().collect():  # two rows a transition at most
        counts[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]
    ordinary, random = map(smoothed, counts)
    return [math.log(random[i][j] / ordinary[i][j]) for i in range(n) for j in range(n)]


def stretches(value: Column, model: list[float], margin: float) -> Column:
    """Sorted array of (a, b), the stretches of a run that score over the margin.

    Every window of ``LEAST`` characters with a letter and a mean over the margin counts, where transitions from or to a
    separator never add; overlapping windows are one stretch. Its ends are trimmed to where the first and last window
    score best, then widened to the separators around them; if fewer than ``LEAST`` characters are left, it stays as it was.
    """
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    n, k = len(ALPHABET), LEAST - 1
    pairs = "array<struct<a:int,b:int>>"
    one = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))

    def gains(codes: Column) -> Column:
        def own(c: Column, i: Column) -> Column:
            before = F.get(codes, i - 1)
            gain = F.get(table, (before - 1) * n + c - 1)
            return F.when(i > 0, F.when(F.greatest(before, c) > SEPARATOR, F.least(gain, F.lit(0.0))).otherwise(gain) - margin).otherwise(0.0)

        return F.transform(codes, own)

    def found(codes: Column, gain: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("letter"), F.lit(0.0).alias("sum"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast(pairs).alias("out"))

        def step(acc: Column, c: Column) -> Column:
            i = acc["i"]
            letter = F.when(c <= 52, i).otherwise(acc["letter"])
            total = acc["sum"] + F.get(gain, i) - F.when(i >= k, F.get(gain, i - k)).otherwise(0.0)
            hot = (i >= k) & (total > 1e-9) & (letter >= i - k)
            fresh = hot & (acc["b"] < i - k)
            out = F.when(fresh & (acc["b"] > 0), F.concat(acc["out"], one(acc["a"], acc["b"]))).otherwise(acc["out"])
            return F.struct((i + 1).alias("i"), letter.alias("letter"), total.alias("sum"), F.when(fresh, i - k).otherwise(acc["a"]).alias("a"), F.when(hot, i + 1).otherwise(acc["b"]).alias("b"), out.alias("out"))

        return F.aggregate(codes, start, step, lambda acc: F.when(acc["b"] > 0, F.concat(acc["out"], one(acc["a"], acc["b"]))).otherwise(acc["out"]))

    def best(places: Column, gain: Column, first: Column, shift: int) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), first.alias("at"))

        def step(acc: Column, j: Column) -> Column:
            total = acc["sum"] + F.get(gain, j)
            return F.struct(total.alias("sum"), F.greatest(total, acc["best"]).alias("best"), F.when(total > acc["best"], j + shift).otherwise(acc["at"]).alias("at"))

        return F.aggregate(places, start, step, lambda acc: acc["at"])

    def ends(s: Column, gain: Column) -> Column:
        a = best(F.sequence(s["a"] + k, s["a"] + 1, F.lit(-1)), gain, s["a"] + k, -1)
        b = best(F.sequence(s["b"] - k, s["b"] - 1), gain, s["b"] - k, 1)
        piece = lambda text: F.char_length(F.regexp_extract(text, "^[A-Za-z0-9]*+", 0))
        wide = let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.struct((x["a"] - piece(F.reverse(F.substr(value, F.lit(1), x["a"])))).alias("a"), (x["b"] + piece(F.substr(value, x["b"] + 1))).alias("b")))
        return let(wide, lambda x: F.when(x["b"] - x["a"] >= LEAST, x).otherwise(s))

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        over = (F.size(acc) > 0) & (s["a"] < F.try_element_at(acc, F.lit(-1))["b"])
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), one(F.least(last["a"], s["a"]), F.greatest(last["b"], s["b"])))
        return F.when(over, merged).otherwise(F.concat(acc, one(s["a"], s["b"])))

    def all_of(codes: Column) -> Column:
        wide = lambda gain: F.transform(found(codes, gain), lambda s: ends(s, gain))
        return F.aggregate(let(gains(codes), wide), F.array().cast(pairs), join)

    return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)), all_of)


def rest(run: Column, base: Column) -> Column:
    """The parts of ``LEAST`` characters or more of a run that no base span covers; the base spans are sorted."""
    part = lambda start, end: F.when(end - start >= LEAST, F.array(F.struct(start.alias("start"), run["kind"].alias("kind"), end.alias("end")))).otherwise(F.array().cast(SPANS))
    near = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    start = F.struct(run["start"].alias("at"), F.array().cast(SPANS).alias("out"))
    step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], part(acc["at"], b["start"])).alias("out"))
    return F.aggregate(near, start, step, lambda acc: F.concat(acc["out"], part(acc["at"], run["end"])))


def found_spans(text: Column, base: Column, runs: Column, model: list[float], margin: float) -> Column:
    """The base spans and those that the models add, sorted."""
    free = F.flatten(F.transform(runs, lambda r: rest(r, base)))
    cut = lambda r: F.substr(text, r["start"] + 1, r["end"] - r["start"])
    free = F.filter(free, lambda r: cut(r).rlike("[A-Za-z]"))

    def secret(r: Column, value: Column) -> Column:
        """A run's stretches; all of the run if its only stretch leaves less than half a window of it."""
        part = lambda s: F.struct((r["start"] + s["a"]).alias("start"), r["kind"].alias("kind"), (r["start"] + s["b"]).alias("end"))
        whole = lambda found: (F.size(found) == 1) & (F.char_length(value) - found[0]["b"] + found[0]["a"] < LEAST // 2)
        return let(stretches(value, model, margin), lambda found: F.when(whole(found), F.array(r)).otherwise(F.transform(found, part)))

    random = F.flatten(F.transform(free, lambda r: let(cut(r), lambda value: secret(r, value))))
    return F.when(F.size(runs) > 0, F.array_sort(F.concat(base, random))).otherwise(base)


def scan(df: DataFrame, model: list[float], margin: float = MARGIN, out: str = "found") -> DataFrame:
    """The input's columns and ``out``, which replaces a column of that name: array of (start, kind, end), sorted; kind
    counts in KINDS. Every other column stays as it is, whatever its name."""
    free = lambda name: next(n for i in count() if (n := f"{name}{i}") not in df.columns)
    base, runs = free("base"), free("runs")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = df.withColumns({base: F.array_sort(F.concat(matched(text, ASSIGN, 0, "value"), matched(text, ACCESS, 1), matched(text, HEX, 2))), runs: matched(text, RUN, 3)})
    return found.withColumn(out, found_spans(text, F.col(base), F.col(runs), model, margin)).drop(base, runs)


def named(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(df: DataFrame, margin: float = MARGIN, max_docs: int = 500) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans, n_markov."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs, fitted(docs, max_docs), margin)
    of = lambda *k: F.filter("found", lambda s: s["kind"].isin(*k))
    count = [F.size(of(i)).cast("long").alias(f"n_{KINDS[i]}") for i in range(4)]
    return found.select("doc_id", *count[:3], F.sha2(named(of(0, 1, 2)), 256).alias("base_sha256"), named(F.col("found")).alias("spans"), count[3])


def fitted(docs: DataFrame, max_docs: int = 500) -> list[float]:
    return train(made_samples(docs.sparkSession).unionByName(corpus_samples(docs, max_docs)))


def redact(df: DataFrame, model: list[float], margin: float = MARGIN, mark: str = "[SECRET]") -> DataFrame:
    """The input, all its columns, with every span in text replaced by a mark; rows without a span keep their text as it
    is, a null one too. What stands between two spans is cut out of the text and joined once."""
    text = F.col("text")
    own = next(n for i in count() if (n := f"found{i}") not in df.columns)

    def apart(spans: Column) -> Column:
        """Spans that overlap as one."""

        def step(acc: Column, s: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            one = F.struct(s["start"].alias("start"), s["end"].alias("end"))
            wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
            return F.when(F.coalesce(last["end"] > s["start"], F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.array_append(acc, one))

        return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)

    def clean(spans: Column) -> Column:
        before = F.transform(spans, lambda s, k: F.concat(let(F.when(k > 0, F.get(spans, k - 1)["end"]).otherwise(0), lambda at: F.substr(text, at + 1, s["start"] - at)), F.lit(mark)))
        return F.concat(F.array_join(before, ""), F.substr(text, F.element_at(spans, -1)["end"] + 1))

    found = scan(df, model, margin, own)
    return found.withColumn("text", F.when(F.size(own) > 0, let(apart(F.col(own)), clean)).otherwise(text)).drop(own)
