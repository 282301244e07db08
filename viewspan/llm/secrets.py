"""Secret scans with DataFrame functions only: base patterns, and two character Markov models compared on opaque strings.

Offsets of matches come from splitting a text at a pattern: the pieces between
the matches and the matches themselves add up to the text, so running sums of
their lengths (in code points) give every start and end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, spare

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ of 18 characters or more: runs are maximal
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_MIN = 12
#: Strings that the Markov models judge: opaque runs of at least so many characters.
OPAQUE_MIN = 20
OPAQUE = rf"[A-Za-z0-9+/_=-]{{{OPAQUE_MIN},}}"
#: Log-likelihood ratio from which a piece of an opaque run is a secret: in nats a pair of characters, and over all its pairs.
MIN_RATIO, MIN_TOTAL = 0.35, 9.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Labelled samples of each class, at most.
SAMPLES = 4_000
# Parts of ordinary identifiers.
IDENTIFIER_PARTS = (
    "get set add remove update delete create load save parse format build make find search list count index item value key name type "
    "user account order customer product price total amount date time start end begin first last next previous current default max min "
    "file path data table column row record field query result error message request response client server session config option param "
    "string number integer float double array map node tree graph edge image video audio text line page section header footer button "
    "window view model controller service manager handler factory builder adapter listener event state action reducer store version test"
).split()

# Words of four languages, for runs of prose.
WORDS = (
    "the and that with have this from they which would there their what about when make like time just know people into year good some could "
    "them other than then look only come over think also back after work first well even want because these give most information nation "
    "question direction government understanding something everything through thought enough development international environment "
    "und der die das nicht mit sich auch auf eine werden haben wird sind noch nach durch einer wurde zwischen schon immer gesellschaft "
    "wissenschaft entwicklung freiheit einheit moeglichkeit verbindung verstehen geschichte regierung wirtschaft sprache arbeit schule "
    "bereich einfach deutsch unterschied beziehung pflicht empfehlung gesundheit schwierigkeit versicherung natuerlich herstellung erfahrung "
    "les des est une que pour dans qui par sur pas plus avec sont mais comme tout nous fait cette aussi leur bien peut sans entre deux "
    "gouvernement mouvement beaucoup nouveau quelle bouteille travail famille question maison toujours mieux jeux heureux chaque quelque "
    "evenement changement environnement eau tableau château lumiere premiere derniere "
    "los las del una por con para como pero sus este entre cuando muy sin sobre ser tiene todo esta desde nos durante estados uno contra "
    "ciudad universidad desarrollo gobierno importante momento trabajo nacional politica sociedad realidad posibilidad solamente lentamente "
    "corazon informacion educacion mujeres hombres tierra guerra pueblo "
    "lorem ipsum dolor amet consectetur adipiscing elit http https www com org index html src docs images module package example project"
).replace("â", "a").split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``(label, s)``: ``n`` random strings (hexadecimal, base64 and upper-case digests, letters alone) and ``n`` ordinary ones (snake, camel and kebab case, paths, words of four languages run together, rules and numbers)."""
    array = lambda words: F.array(*[F.lit(w) for w in words])
    pick = lambda k, of, n: F.element_at(of, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)) + 1).cast("int"))
    kind = F.pmod("id", F.lit(8))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), r"[^A-Za-z0-9+/=]", "")
    safe, letters = F.translate(b64, "+/=", "-_"), F.regexp_replace(b64, "[^A-Za-z]", "")
    random = (
        F.when(kind == 0, digest).when(kind == 1, b64).when(kind == 2, F.regexp_replace(b64, "[+/=]", "")).when(kind == 3, F.upper(F.regexp_replace(b64, "[+/=]", "")))
        .when(kind == 4, safe).when(kind == 5, letters).when(kind == 6, F.lower(letters)).otherwise(F.lower(F.regexp_replace(b64, "[+/=]", "")))
    )
    parts, words = array(IDENTIFIER_PARTS), array(WORDS)
    four, prose = [pick(k, parts, len(IDENTIFIER_PARTS)) for k in range(4)], [pick(k, words, len(WORDS)) for k in range(10, 15)]
    turn, rules = F.floor(F.col("id") / 8), "".join(c for c in ALPHABET if c not in "0123456789abcdef")  # of those a base pattern takes runs
    number = F.abs(F.xxhash64("id")).cast("string")
    plain = (
        F.when(kind == 0, F.when(turn % 2 == 0, F.concat_ws("_", *four)).otherwise(F.upper(F.concat_ws("_", *four))))
        .when(kind == 1, F.concat(four[0], *[F.initcap(p) for p in four[1:]]))
        .when(kind == 2, F.concat_ws("/", F.concat_ws("-", *four[:2]), *four[2:]))
        .when(kind == 3, F.concat(*four, F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")))
        .when(kind == 4, F.concat(*prose))
        .when(kind == 5, F.concat(F.initcap(prose[0]), *prose[1:]))
        .when(kind == 6, F.concat_ws("-", *prose[:3], F.lit("2"), F.upper(prose[3])))
        .otherwise(F.concat(F.repeat(F.lit(rules).substr((F.pmod(turn, F.lit(len(rules))) + 1).cast("int"), F.lit(1)), 60), F.substring(number, 1, 8), F.lit("-"), F.upper(prose[4])))
    )
    ids = spark.range(n)
    return ids.select(F.lit("random").alias("label"), random.alias("s")).union(ids.select(F.lit("ordinary"), plain))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios random : ordinary of each pair of characters, ``pair = before * size + after`` (add-one smoothing).

    Counted from all rows of ``samples(label, s)``; a table of the alphabet's square comes to the driver.
    """
    size = len(ALPHABET)
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = samples.where(F.length("s") > 1).select("label", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
    pairs = pairs.select("label", place(F.col("s").substr(F.col("i"), F.lit(1))).alias("a"), place(F.col("s").substr(F.col("i") + 1, F.lit(1))).alias("b")).where("a >= 0 and b >= 0")
    counts: dict[str, list[list[int]]] = {k: [[1] * size for _ in range(size)] for k in ("random", "ordinary")}
    for r in pairs.groupBy("label", "a", "b").count().collect():
        counts[r["label"]][r["a"]][r["b"]] += r["count"]
    p = {k: [[math.log(c / sum(row)) for c in row] for row in m] for k, m in counts.items()}
    return [round(p["random"][a][b] - p["ordinary"][a][b], 6) for a in range(size) for b in range(size)]


#: Code points of a page of a text that is cut up.
PAGE = 2000
#: Spans worked on together: arrays grow by so many, so that building one takes time in proportion to its length.
RUN = 64
SPANS = "array<struct<start:bigint,kind:int,end:bigint,s:string>>"
NO_SPANS = f"cast(array() as {SPANS})"


def _chunks(spans: Column) -> Column:
    """``spans`` in arrays of at most ``RUN``."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int")), lambda c: F.slice(s, c * RUN + 1, F.lit(RUN)))
    return _let(spans, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array()))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of a pattern's matches; ``keep(whole match)`` may drop some."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(NO_SPANS).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("s")))).alias("out"))

    # spans of each chunk from its own beginning, then where chunks begin
    own = F.transform(_chunks(rows), lambda chunk: F.aggregate(chunk, zero, step))
    begin = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    begins = lambda o: F.aggregate(o, F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")), begin, lambda a: a["out"])
    moved = lambda c, at: F.transform(c["out"], lambda x: F.struct((x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end"), x["s"].alias("s")))
    all_of = _let(own, lambda o: F.flatten(F.zip_with(o, begins(o), moved)))
    return F.when(text.rlike(pattern), F.filter(all_of, lambda x: keep(x["s"])) if keep else all_of).otherwise(F.expr(NO_SPANS))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _uncovered(runs: Column, base: Column) -> Column:
    """The pieces of the spans ``runs`` that no span of ``base`` (by start) covers, as spans."""

    def piece(run, start, end):
        return F.struct(start.alias("start"), run["kind"].alias("kind"), end.alias("end"), run["s"].substr((start - run["start"] + 1).cast("int"), (end - start).cast("int")).alias("s"))

    touches = lambda run: lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])
    # of each chunk of base spans the reach, so that a run looks only into chunks that it may touch
    reach = lambda c: F.struct(F.element_at(c, 1)["start"].alias("start"), F.array_max(F.transform(c, lambda b: b["end"])).alias("end"), c.alias("spans"))

    def left(run, chunks):
        near = F.flatten(F.transform(F.filter(chunks, touches(run)), lambda c: F.filter(c["spans"], touches(run))))
        zero = F.struct(run["start"].alias("at"), F.expr(NO_SPANS).alias("out"))

        def step(acc, b):
            out = F.when(b["start"] > acc["at"], F.concat(acc["out"], F.array(piece(run, acc["at"], b["start"])))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), out.alias("out"))

        last = lambda a: F.when(a["at"] < run["end"], F.concat(a["out"], F.array(piece(run, a["at"], run["end"])))).otherwise(a["out"])
        return _let(near, lambda t: F.when(F.size(t) > 0, F.aggregate(t, zero, step, last)).otherwise(F.array(run)))

    def left_of_chunk(own, chunks):
        near = _let(reach(own), lambda r: F.filter(chunks, touches(r)))
        return _let(near, lambda c: F.flatten(F.transform(own, lambda run: left(run, c))))

    cut = lambda r, b: _let(F.transform(_chunks(b), reach), lambda chunks: F.flatten(F.transform(_chunks(r), lambda own: left_of_chunk(own, chunks))))
    return _let(runs, lambda r: _let(base, lambda b: F.when(F.size(b) > 0, cut(r, b)).otherwise(r)))


def with_secrets(docs: DataFrame, ratios: list[float], text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with ``name``: array<struct<start, kind, end, s>> of all spans, by start and then kind (a place in ``KINDS``).

    Base spans (``assign``, ``access``, ``hex``) are all there; ``markov`` spans
    are opaque runs, or what base spans leave uncovered of them, whose
    log-likelihood ratio alone says random rather than ordinary: a short piece
    needs a higher one a character. Offsets count code points, the end is
    exclusive. Null texts have no spans. Nothing is shuffled and other columns
    pass through.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # a literal once the plan is optimised
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_MIN
    base, opaque = spare(docs, "_vs_base"), spare(docs, "_vs_opaque")
    out = docs.withColumn(base, F.sort_array(F.concat(_spans(t, ASSIGN, 0, value), _spans(t, ACCESS, 1), _spans(t, HEX, 2))))
    out = out.withColumn(opaque, _uncovered(_spans(t, OPAQUE, 3), F.col(base)))
    place = lambda s, i: F.instr(F.lit(ALPHABET), s.substr(i, F.lit(1))) - 1

    def total(x):
        pairs = F.sequence(F.lit(1), F.length(x["s"]) - 1)
        return F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.get(table, (place(x["s"], i) * size + place(x["s"], i + 1)).cast("int")))

    out = out.withColumn(opaque, F.filter(opaque, lambda x: F.when(F.length(x["s"]) > 1, total(x) >= F.greatest(F.lit(MIN_TOTAL), MIN_RATIO * (F.length(x["s"]) - 1))).otherwise(False)))
    return out.withColumn(name, F.sort_array(F.concat(base, opaque))).drop(base, opaque)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones together, replaced by ``mark``; without spans the text itself."""
    # what comes before each span that begins after all before it have ended, and after the last one
    gap_list = "array<struct<start:bigint,end:bigint>>"
    kept = f"cast(array() as {gap_list})"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(kept).alias("out"))

    def step(acc, x):
        gap = F.array(F.struct(acc["at"].alias("start"), x["start"].alias("end")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    # chunk by chunk, so that only the gaps of a chunk are copied at each step
    def chunk_step(acc, chunk):
        own = F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.expr(kept).alias("out")), step)
        return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{gap_list}>)").alias("out"))
    gaps = F.aggregate(_chunks(spans), start, chunk_step, lambda a: F.concat(F.flatten(a["out"]), F.array(F.struct(a["at"].alias("start"), F.length(text).cast("long").alias("end")))))
    # pieces of the text of bounded length, so that none is searched from the text's beginning
    pages = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PAGE), F.lit(0))

    def part(pages, g):
        first = F.floor(g["start"] / PAGE).cast("int")
        span = F.array_join(F.slice(pages, first + 1, F.floor(F.greatest(g["start"], g["end"] - 1) / PAGE).cast("int") - first + 1), "")
        return F.when(g["end"] > g["start"], F.substring(span, (g["start"] - first * PAGE + 1).cast("int"), (g["end"] - g["start"]).cast("int"))).otherwise("")

    return F.when(F.size(spans) > 0, _let(pages, lambda p: F.array_join(F.transform(gaps, lambda g: part(p, g)), mark))).otherwise(text)


def secret_scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of op1 for each row of ``docs``."""
    found = with_secrets(docs.select(F.col(id_col), F.col(text).alias("text")), ratios)
    n = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        id_col,
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        n(3).alias("n_markov"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"), train(labelled_samples(spark)))
