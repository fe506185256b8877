"""Secret scanning with DataFrame operations only.

Three base patterns find assignments, access keys and hex strings. Beyond them, two character
Markov models, one of random strings and one of ordinary identifiers, are trained from labelled
samples; a run of token characters, of any length, that no base span overlaps is a secret when the
log-likelihood ratio of the models is high enough, in total and per character: the ratio itself asks
for some ten characters. Runs of digits alone aren't told from ordinary numbers. All positions are
code points.

Each different run of a text is judged once; positions are made only in texts where one is a secret.
They come from the lengths of matches and of the text between them, summed in two levels of
blocks; base spans near a run are found by binary search, as each pattern's spans are apart and in
order. So a text with n matches costs about n * log(n) small steps, and nothing is shuffled or grouped.
What a lambda reads more than once is bound to a variable first (_let), as Catalyst would otherwise
put its expression into the lambda and compute it at every step.

Defined results: null texts count as empty; empty texts have no spans; every input row keeps its
own row, whatever its id, so repeated rows each have theirs; texts of any length are scanned whole;
spans of one start stand in the order of their kinds; without documents the ordinary model rests on
the built-in samples alone. Input columns of any name pass, but for one named spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Made, drop, only, stored

# fixed values: the base patterns, in the order of their kinds
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # and the state before the first character
RUN = r"[A-Za-z0-9+/_=-]+"
SAMPLE_DOCS = 2000  # most documents that ordinary identifiers are sampled from
SAMPLE_RANDOM = 2000  # random strings of each form
# words that built-in samples of identifiers are made of
COMMON = """access account action address admin agent alert amount api archive array async author auto backup balance batch binary block branch
bucket button bytes cache card catalog channel check class client clock color column command config context crypto currency customer
cycle data debug default delete deploy device domain dynamic edge email encrypt enqueue error example export extra feature fetch field
filter flag folder gateway github graph group handler hash height history html hub identity image index input invoice item javascript
json jump kernel key kubernetes layer ledger length level library lock lookup map matrix metric module network node notify object option
oracle order owner package parent password path payload policy proxy python query queue quota random region registry report request
resource result retry router schedule schema screen script search select server session shadow skype socket source sqlite stack status
storage stream string struct submit switch symbol sync system table tag target task template tenant thread timezone token trace traffic
transfer trigger tuple twig type unique update upload url user uuid value vector version video view virtual volume wallet webhook weekly
widget window wizard worker wrapper write xml yaml year zero zip zone"""
# least log-likelihood ratio of a secret, and per character: the first says that a run is worth 14 nats
# more as a secret, so that about one run in a million may be one, and is what asks for some ten
# characters; random strings have 1.2 per character and more, compounds of words 0.7 and less
TOTAL, MEAN = 14.0, 0.9
SMOOTH = 0.02  # weight of the classes of characters in the ordinary model

_BLOCK = 64


def _let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, base: Column) -> Column:
    """base plus the running sums of values."""
    start = F.struct(base.cast("int").alias("sum"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(values, start, lambda acc, x: _let((acc["sum"] + x).cast("int"), lambda s: F.struct(s.alias("sum"), F.concat(acc["all"], F.array(s)).alias("all"))), lambda acc: acc["all"])


def _in_blocks(values: Column) -> Column:
    """An array cut to arrays of _BLOCK values each."""
    n = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def _sums(steps: Column) -> Column:
    """Running sums of a column that isn't empty: by block, then inside blocks."""

    def inside(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: (a + x).cast("int")))
        bases = F.concat(F.array(F.lit(0)), _running(sums, F.lit(0)))
        return F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda block, base: _running(block, base)))

    return _let(steps, lambda s: _let(_in_blocks(s), inside))


def _starts(between: Column, matches: Column) -> Column:
    """Start of each match, from the texts before them."""
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), F.concat(F.array(F.lit("")), matches), lambda gap, before: F.length(F.coalesce(gap, F.lit(""))) + F.length(F.coalesce(before, F.lit(""))))
    return _sums(F.slice(steps, F.lit(1), F.size(matches)))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(df: DataFrame, name: str, kind: int, pattern: str, least: int = 0, group: int = 0) -> DataFrame:
    """Add a column of the pattern's spans whose text (or group) is long enough."""
    none = F.array().cast(_SPAN)
    df = df.withColumn("_m", F.regexp_extract_all("text", F.lit(pattern), 0))
    df = df.withColumn("_b", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.regexp_extract_all("text", F.lit(pattern), group)) if group else F.col("_m"))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, _starts(F.col("_b"), F.col("_m"))))
    whole = F.zip_with("_m", "_s", lambda m, s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).cast("int").alias("end")))
    long_enough = F.filter(F.zip_with(whole, "_g", lambda x, g: F.struct(x.alias("x"), F.length(g).alias("n"))), lambda p: p["n"] >= least)
    spans = F.transform(long_enough, lambda p: p["x"]).cast(_SPAN)
    df = df.withColumn(name, F.when(F.size("_m") > 0, spans).otherwise(none))
    return df.drop("_m", "_b", "_g", "_s")


def _begun(starts: Column, end: Column) -> Column:
    """How many of the sorted starts are below end, by halving."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(starts) + 1.0)).cast("int"))

    def halve(a: Column, _: Column) -> Column:
        mid = ((a["lo"] + a["hi"]) / 2).cast("int")
        below = _let(mid, lambda m: F.when(a["lo"] >= a["hi"], a).when(F.element_at(starts, m + 1) < end, F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))
        return below

    return F.aggregate(halvings, zero, halve, lambda a: a["lo"])


def _free(free: Column, kinds: list[Column]) -> Column:
    """Those of the runs (s, m) that no span of these kinds overlaps; spans of a kind are apart and sorted."""
    for spans in kinds:

        def outside(pair: Column, spans: Column = spans) -> Column:
            # the last span that begins before the run's end is the only one that can reach into it
            clear = lambda both, x: _let(_begun(both["starts"], x["s"]["end"]), lambda n: (n == 0) | (F.element_at(both["ends"], F.greatest(n, F.lit(1))) <= x["s"]["start"]))
            return _let(F.struct(F.transform(spans, lambda s: s["start"]).alias("starts"), F.transform(spans, lambda s: s["end"]).alias("ends")), lambda both: F.filter(pair, lambda x: clear(both, x)))

        free = F.when(F.size(spans) > 0, outside(free)).otherwise(free)
    return free


def _codes(text: Column) -> Column:
    """The model's states of a string's characters."""
    return F.transform(F.split(text, "", -1), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def labelled_samples(docs: DataFrame, limit: int = SAMPLE_DOCS, size: int = SAMPLE_RANDOM) -> DataFrame:
    """(text, secret, origin): random strings of six forms, built-in names, and runs and compounds of at most `limit` documents.

    The documents are those of the smallest hash of doc_id. Runs of any length count, but for what a
    base pattern matches and what a first model, of the random strings and built-in names alone, finds.
    """
    spark = docs.sparkSession
    n = spark.range(size).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hex"))
    base64 = F.regexp_replace(F.base64(F.unhex("hex")), "=", "")
    letters = F.regexp_replace(base64, "[+/]", "")
    forms = F.array(base64, letters, F.upper(F.substring(letters, 1, 36)), F.lower(F.substring(letters, 1, 36)), F.concat(F.substring(base64, 1, 20), F.lit("-"), F.substring("hex", 1, 12)), F.col("hex"))
    random = n.select(F.explode(forms).alias("text"), F.lit(True).alias("secret"), F.lit("random").alias("origin"))
    known = random.unionByName(built_in(spark, size))
    first = train(known).select("ratio").scalar()
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), "AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", " ")
    runs = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.regexp_extract_all(text, F.lit(RUN), 0).alias("w"))
    runs = runs.withColumn("_ratio", first).select(F.filter("w", lambda m: ~_secret(m, F.col("_ratio"), TOTAL, MEAN)).alias("w"))
    pairs = F.zip_with("w", F.concat(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(1))), F.array(F.lit("id"))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit("id")).alias("b")))
    forms = lambda p: F.array(p["a"], F.concat_ws("_", p["a"], p["b"]), F.concat(F.lower(p["a"]), F.initcap(p["b"])), F.upper(F.concat_ws("-", p["a"], p["b"])), F.concat(p["a"], F.lit("/"), p["b"]))
    # a condition on the runs, or one that explode() implies, would be pushed below the join, and judge all documents
    some = F.filter(pairs, lambda p: p["a"].isNotNull())
    ordinary = runs.select(F.explode_outer(F.flatten(F.transform(some, forms))).alias("text"), F.lit(False).alias("secret"), F.lit("documents").alias("origin")).filter("text is not null")
    return known.unionByName(ordinary)


def built_in(spark, size: int) -> DataFrame:
    """Ordinary samples that any text may hold: compounds of common words, numbered names, dates, paths, rules and numbers."""
    words = F.split(F.lit(" ".join(COMMON.split())), " ")
    count = len(COMMON.split())
    pick = lambda step, plus: F.element_at(words, (F.pmod(F.col("id") * step + plus, F.lit(count)) + 1).cast("int"))
    n = spark.range(size).select("id", pick(1, 0).alias("a"), pick(7, 3).alias("b"), pick(31, 11).alias("c"), (F.col("id") % 97).cast("string").alias("k"), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 7).cast("int")), "yyyy-MM-dd").alias("day"))
    names = [F.concat_ws("_", "a", "b", "c"), F.concat("a", F.initcap("b"), F.initcap("c")), F.concat(F.initcap("a"), F.initcap("b"), F.initcap("c")), F.upper(F.concat_ws("_", "a", "b", "c")), F.concat_ws("-", "a", "b", "k"), F.concat_ws("/", "a", "b", "c", "k"), F.upper(F.concat("a", "b")), F.concat("a", "k", F.lit("_"), "b"), F.concat_ws("-", "day", "a", "b"), F.concat_ws("=", "a", "k")]
    rules = [F.expr(f"repeat('{c}', cast(20 + id % 40 as int))") for c in "-=_/+"]
    numbers = [(F.col("id") * 7919 % 100000).cast("string"), (F.col("id") * 1037389 + 1000000000).cast("string")]
    return n.select(F.explode(F.array(*names, *rules, *numbers)).alias("text"), F.lit(False).alias("secret"), F.lit("built-in").alias("origin"))


def _class(state: Column) -> Column:
    """Lower case, upper case, digits, then each other character by itself; 0 is the state before the first."""
    return F.when(state == 0, 0).when(state <= 26, 1).when(state <= 52, 2).when(state <= 62, 3).otherwise(state - 59)


def train(samples: DataFrame, smooth: float = 0.5, by_class: float = SMOOTH) -> DataFrame:
    """A stored row: `ratio`, the log-likelihood ratio of every (state, next state), by state * STATES + next.

    The random model is smoothed by a constant. The ordinary one gives each origin of samples that knows
    a state the same weight, however many samples it has, and `by_class` to the classes of characters,
    so that a step that no sample has costs what a rare one of its classes would.
    """
    steps = samples.withColumn("c", _codes(F.col("text"))).withColumn("c", F.filter("c", lambda x: x > 0))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.col("c")), F.col("c"), lambda a, b: a * STATES + b)
    sorts = {"random": F.col("secret"), "built": ~F.col("secret") & (F.col("origin") == "built-in"), "own": ~F.col("secret") & (F.col("origin") != "built-in")}
    counted = steps.select("secret", "origin", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("step")).groupBy("step").agg(*[F.count_if(of).alias(k) for k, of in sorts.items()])
    # counts of each of the fixed number of steps, of its state, of its state's class and of both classes
    counted = stored(counted, "counts")
    full = samples.sparkSession.range(STATES * STATES, numPartitions=1).select(F.col("id").cast("int").alias("step")).join(counted, "step", "left").fillna(0, [*sorts])
    full = full.withColumns({"state": F.floor(F.col("step") / STATES), "to": F.col("step") % STATES}).withColumns({"class": _class(F.col("state")), "class_to": _class(F.col("to"))})
    for tag, keys in {"state": ["state"], "class": ["class"], "classes": ["class", "class_to"]}.items():
        full = full.withColumns({f"{k}_{tag}": F.sum(k).over(Window.partitionBy(*keys)) for k in sorts})
    alike = F.when(F.col("class_to").isin(1, 2), 26).when(F.col("class_to") == 3, 10).otherwise(1)

    def step(k: str) -> Column:
        return F.when(F.col(f"{k}_state") > 0, F.col(k) / F.col(f"{k}_state")).otherwise(0.0)

    def rare(k: str) -> Column:
        return (F.col(f"{k}_classes") + smooth) / (F.col(f"{k}_class") + smooth * 9) / alike

    share = (1 - by_class) / 2
    knows = F.lit(by_class) + sum((F.when(F.col(f"{k}_state") > 0, share).otherwise(0.0) for k in ("built", "own")), F.lit(0.0))
    ordinary = (share * (step("built") + step("own")) + by_class / 2 * (rare("built") + rare("own"))) / knows
    random = (F.col("random") + smooth) / (F.col("random_state") + smooth * STATES)
    ratio = full.select("step", F.log(random / ordinary).alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "r"))), lambda x: x["r"]).alias("ratio"))
    ratio = stored(ratio, "model")
    drop(counted)
    return ratio


def _secret(run: Column, ratio: Column, total: float, mean: float) -> Column:
    """Whether the models' ratio calls a run of token characters a secret."""
    zero = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("sum"))
    # `ratio` is read in the lambda and has to be a column of its own
    value = F.aggregate(_codes(run), zero, lambda a, c: F.when(c == 0, a).otherwise(F.struct(c.alias("p"), (a["sum"] + F.element_at(ratio, a["p"] * STATES + c + 1)).alias("sum"))), lambda a: a["sum"])
    return _let(value, lambda v: (v >= total) & (v >= F.length(run) * mean))


def scan(docs: DataFrame, model: DataFrame | None = None, total: float = TOTAL, mean: float = MEAN) -> DataFrame:
    """The input's columns and `spans`: array of (start, kind, end), base kinds 0 to 2 and 3 for the model's, by start then kind.

    An input column of that name gives way.
    """
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c != "spans"]
    return _scanned(docs, model, total, mean).select(*kept, F.col("_spans").alias("spans"))


def _scanned(docs: DataFrame, model: DataFrame | None = None, total: float = TOTAL, mean: float = MEAN) -> DataFrame:
    """_row (all of the input's columns), text (null as empty) and _spans."""
    if model is None:
        with Made() as made:
            model = train(labelled_samples(only(docs, "doc_id", "text")))
        made.delete(docs.sparkSession, model)
    ratio = model.select("ratio").scalar()
    kept = docs.columns
    # everything but the text waits in one column, so no name of the input can clash
    df = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    df = _spans(df, "_assign", 0, ASSIGN, LEAST["assign"], 1)
    df = _spans(df, "_access", 1, r"AKIA[A-Z0-9]{16,}")
    df = _spans(df, "_hex", 2, r"[0-9a-f]{24,}")
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_m", F.regexp_extract_all("text", F.lit(RUN), 0)).withColumn("_ratio", ratio)
    # texts without any such run, nearly all, are done once each of their different runs is judged
    judge = lambda m: _secret(m, F.col("_ratio"), total, mean)
    df = df.withColumn("_some", F.exists(F.array_distinct("_m"), judge))
    df = df.withColumn("_s", F.when(F.col("_some"), _starts(F.split("text", RUN, -1), F.col("_m"))))
    runs = F.zip_with("_m", "_s", lambda m, s: F.struct(F.struct(s.alias("start"), F.lit(3).alias("kind"), (s + F.length(m)).cast("int").alias("end")).alias("s"), m.alias("m")))
    df = df.withColumn("_run", F.when(F.col("_some"), F.filter(runs, lambda x: judge(x["m"])))).drop("_m", "_s")
    free = _free(F.col("_run"), [F.col("_assign"), F.col("_access"), F.col("_hex")])
    spans = F.when(F.col("_some"), F.array_sort(F.concat("_base", F.transform(free, lambda x: x["s"]).cast(_SPAN)))).otherwise(F.col("_base"))
    return df.select("_row", "text", spans.alias("_spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pieces(spans: Column, mark: str) -> Column:
    """The text with marks in place of sorted spans; one inside an earlier one adds nothing, and one that begins inside it adds a mark.

    Each block of spans works on its own stretch of the text, cut out once.
    """
    most = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))

    def stretch(block: Column, begin: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            gap = lambda a: F.when(s["start"] > a["to"], F.substr(a["own"], a["to"] - begin + 1, s["start"] - a["to"])).otherwise(F.lit(""))
            return F.when(s["end"] <= a["to"], a).otherwise(F.struct(a["own"].alias("own"), s["end"].alias("to"), F.concat(a["parts"], F.array(gap(a), F.lit(mark))).alias("parts")))

        own = F.substr(F.col("text"), begin + 1, F.greatest(most(block) - begin, F.lit(0)))
        zero = F.struct(own.alias("own"), begin.alias("to"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(block, zero, step, lambda a: F.array_join(a["parts"], ""))

    def whole(blocks: Column) -> Column:
        # where each block's stretch begins: after all spans of the blocks before
        zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("all"))
        begins = F.aggregate(blocks, zero, lambda a, b: F.struct(F.greatest(a["to"], most(b)).alias("to"), F.concat(a["all"], F.array(a["to"])).alias("all")), lambda a: F.concat(a["all"], F.array(a["to"])))
        return _let(begins, lambda x: F.concat(F.array_join(F.zip_with(blocks, F.slice(x, F.lit(1), F.size(blocks)), stretch), ""), F.substr(F.col("text"), F.element_at(x, -1) + 1)))

    return _let(_in_blocks(spans), whole)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows with every span of their text replaced by the mark; n_chars, if there, follows."""
    found = _scanned(docs)
    some = F.size("_spans") > 0
    found = found.withColumn("_text", F.when(some, _pieces(F.col("_spans"), mark)).otherwise(F.col("_row")["text"]))
    new = {"text": F.col("_text"), "n_chars": F.when(some, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
