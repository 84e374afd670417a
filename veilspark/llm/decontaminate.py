"""Benchmark decontamination by canonical templates, with slot checks.

Texts become templates of units: numbers, names and units of measure give way
to typed placeholders, other words to lower case without punctuation. A text
has two templates. In the first, capitalised words are names, wherever they
stand, and words of a name that follow each other are one placeholder, so a
copy may have other names of other lengths. In the second names are words like
any others, so a copy may be written in capitals, in lower case or In Title
Case. Windows of a document's templates are joined by their hash to those of
the benchmark. Where windows of a document and of an item line up, the values
in the placeholders are compared: a re-parameterised copy gives each value of
the item one value of its own throughout, or the windows with the item's own
values are enough by themselves. Windows that are mostly placeholders and
short items would match clean text by their templates; in the second template
they are plain, joined by the hash of their lower-case words. Only built-in
functions are used.

A document's words are hashed once; a window's hash is taken of the hashes of
its words, in generated code, and looked up before anything else is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

WINDOW = 8
#: Items of fewer words match by their words only, ones shorter than WINDOW as a whole.
MIN_WORDS = 5
#: Windows of one alignment that make a leak (or all that the item has).
MIN_WINDOWS = 3
#: Placeholders that a window may have at most; with more it is plain.
MAX_SLOTS = 4
#: Between two sentences or lines of an item.
_BREAK = r"(?:[.!?…][^\p{L}\p{N}\s]*\s|[。！？।\n])[^\p{L}\p{N}]*[\p{L}\p{N}]"
#: Windows (of a few numbers) and their words are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
WINDOW_BYTES = 64
BROADCAST_DOCS = 1_000_000
NUM, NAME, UNIT = "\x02", "\x03", "\x04"
#: After a word of a name, where the name goes on (a private character; where a
#: text has it itself, the words around it count as one name).
GLUE = "\ue000"
NAMES, WORDS = 1, 2
#: Units that are placeholders after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs min mins h hr hrs kb mb gb tb hz khz mhz ghz v w kw a j k c f usd eur gbp inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ounce ounces pound pounds liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"


def canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with w1 and t1, the units of ``text`` and their template with
    names, w2 and t2, the same without names, and p, the lower-case words.

    A name is a word with a capital in front and a small letter in it, with
    the names that follow after blanks. What is neither letter, number nor
    white space is left out. Texts without words have one unit, the empty word.
    """
    glued = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{Lu}\p{L}*+(?<=\p{Ll}))[ \t]++(?=\p{Lu}\p{L}*\p{Ll})", f"$1{GLUE} ")
    bare = F.regexp_replace(glued, rf"[^\p{{L}}\p{{N}}\x20\x09-\x0D{GLUE}]++", "")
    df = df.withColumn("line", F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[\x20\x09-\x0D]++", "  ")), F.lit(" ")))
    # most texts have few numbers, or none
    numbers = F.regexp_replace("line", rf" [^ \p{{Nd}}]*+\p{{Nd}}[^ {GLUE}]*+({GLUE}?) ", f" {NUM}$1 ")
    df = df.withColumn("numbers", F.when(F.regexp_like("line", F.lit(r"\p{Nd}")), numbers).otherwise(F.col("line")))
    units = F.regexp_replace("numbers", rf" {NUM}  (?:(?i){UNITS.replace(' ', '|')})({GLUE}?) ", f" {NUM}  {UNIT}$1 ")
    df = df.withColumn("numbered", F.when(F.contains("numbers", F.lit(NUM)), units).otherwise(F.col("numbers")))
    joined = lambda c: F.replace(F.col(c), F.lit(f"{GLUE}  "), F.lit(GLUE))
    apart = lambda c: F.replace(F.col(c), F.lit(GLUE), F.lit(""))
    named = F.regexp_replace(joined("numbered"), r" \p{Lu}(?=[^ ]*\p{Ll})[^ ]*+ ", f" {NAME} ")
    units = {"w1": joined("line"), "t1": F.lower(named), "w2": apart("line"), "t2": F.lower(apart("numbered")), "p": F.lower(apart("line"))}
    return df.withColumns({k: F.split(F.trim(v), "  ") for k, v in units.items()}).drop("line", "numbers", "numbered")


def _source(kind: int, plain: bool) -> str:
    return "p" if plain else f"t{kind}"


def _windows(df: DataFrame, shapes: list[tuple[int, bool, int]]) -> DataFrame:
    """``df`` with a row for each window of each shape (kind, plain, size):
    those three, at (from 0) and h, its hash, which tells shapes apart."""
    arrays = sorted({_source(k, p) for k, p, _ in shapes})
    hashed = df.withColumns({f"h_{a}": F.transform(a, lambda x: F.xxhash64(x)) for a in arrays}).drop("w1", "t1", "w2", "t2", "p")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("plain"), F.lit(n).alias("size"), F.col(f"h_{_source(k, p)}").alias("hs")) for k, p, n in shapes])
    rows = hashed.withColumn("s", F.explode(each)).drop(*[f"h_{a}" for a in arrays]).select("*", "s.*").drop("s")
    rows = rows.select("*", F.posexplode("hs").alias("at", "first")).where(F.col("at") + F.col("size") <= F.size("hs"))
    of = lambda n: F.xxhash64("kind", "plain", "first", *[F.get("hs", F.col("at") + i) for i in range(1, n)])
    sizes = sorted({n for _, _, n in shapes})
    h = of(sizes[-1])
    for n in sizes[:-1]:
        h = F.when(F.col("size") == n, of(n)).otherwise(h)
    return rows.withColumn("h", h).drop("hs", "first")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, size, item_id, kind, item_at, plain, item_words, item_template,
    several, n_item, n_template) of the windows of the items; kind is the
    template. n_template: those that aren't plain; several: the item is more
    than one sentence or line.

    The template with names has no plain windows, and is left out where the
    item has no names or fewer than MIN_WORDS units in it.
    """
    items = canonical(benchmark.select("item_id", F.col("text").cast("string").alias("text"))).where(F.col("p")[0] != "")
    items = items.withColumn("several", F.regexp_like(F.trim("text"), F.lit(_BREAK))).drop("text").distinct()
    sizes = {NAMES: F.least(F.lit(window), F.size("t1")), WORDS: F.least(F.lit(window), F.size("t2"))}
    both = [F.struct(F.lit(k).alias("kind"), F.col(f"w{k}").alias("w"), F.col(f"t{k}").alias("t"), n.alias("size")) for k, n in sizes.items()]
    use = F.array_contains("t1", NAME) & (F.size("t1") >= MIN_WORDS)
    each = items.select("item_id", "several", "p", F.inline(F.when(use, F.array(*both)).otherwise(F.array(both[1]))))
    out = each.select("*", F.posexplode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("item_at", "__"))
    cut = lambda c: F.slice(c, F.col("item_at") + 1, F.col("size"))
    out = out.withColumn("item_template", cut("t")).withColumn("slots", F.size(F.filter("item_template", lambda x: x.isin(NUM, NAME, UNIT))))
    dense = (F.size("t") < MIN_WORDS) | (F.col("slots") * 2 > F.col("size")) | (F.col("slots") > MAX_SLOTS)
    out = out.withColumn("plain", dense).where((F.col("kind") == WORDS) | ~dense)
    out = out.withColumn("item_words", F.when(F.col("plain"), cut("p")).otherwise(cut("w")))
    of = F.transform(F.when(F.col("plain"), F.col("item_words")).otherwise(F.col("item_template")), lambda x: F.xxhash64(x))
    h = F.xxhash64("kind", "plain", *[F.get(of, F.lit(i)) for i in range(window)])
    own = Window.partitionBy("item_id", "kind")
    return out.withColumns({"h": h, "n_item": F.count("*").over(own), "n_template": F.count_if(~F.col("plain")).over(own)}).drop("__", "t", "w", "p", "slots")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_windows: int = MIN_WINDOWS, by_text: bool = False) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item, coverage, exact) of each leak.

    docs: (doc_id, text); benchmark: (item_id, text). A leak is an alignment
    of a document with an item in which at least ``min_windows`` windows (or
    all, if the item has fewer) have the same template and consistent slots;
    plain windows have the same words. Where an item has both kinds, all of
    its templates are enough too, if they are fewer than ``min_windows``. Where
    slots aren't consistent, only windows with the same words count, slots
    included: ``min_windows`` of them make a leak too, or 2 ``window`` where the
    item is a single sentence.
    n_windows: those of the best alignment; n_item: the item's; exact: the
    words are the same, slots included, but for case. Copies in other
    capitals are found, with other numbers too, but not with other names.

    Null and empty texts match nothing. Items of fewer than MIN_WORDS words
    match wherever their words stand, an item of one word each text with it. Rows with the same doc_id are looked at apart and reported once,
    with the best alignment, or with ``by_text`` once for each text, whose hash is
    the column text_hash; a null doc_id is reported as null. Repeated items
    count once. Empty tables give an empty one; other columns are ignored.
    """
    bench = materialise(benchmark_windows(benchmark, window), "windows")
    shapes = sorted((r["kind"], r["plain"], r["size"]) for r in bench.select("kind", "plain", "size").distinct().collect())
    n, size = (x or 0 for x in bench.agg(F.count("*"), F.sum(F.octet_length(F.concat(F.array_join("item_words", ""), F.array_join("item_template", ""))) + 16 * F.size("item_words") * 2)).first())
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    each = _windows(canonical(base).drop("text"), shapes or [(WORDS, False, window)]).select("doc_id", "th", "at", "h")
    own = bench.select("h", "size", "item_id", "kind", "item_at").distinct()
    hits = each.join(F.broadcast(own) if n * WINDOW_BYTES <= BROADCAST_BYTES else own, "h").select("doc_id", "th", "at", "size", "item_id", "kind", "item_at")
    hits = materialise(hits.distinct(), "hits")
    # the few documents with hits are looked at again, word by word
    keys = hits.select(F.col("doc_id").alias("i"), F.col("th").alias("k")).distinct()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_DOCS else keys
    again = base.join(keys, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "th"])
    again = materialise(canonical(again.withColumnsRenamed({"doc_id": "i", "th": "k"})).drop("text"), "again")
    small = size + n * WINDOW_BYTES <= BROADCAST_BYTES
    items = bench.drop("h")
    found = hits.join(again, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k"))).join(F.broadcast(items) if small else items, ["size", "item_id", "kind", "item_at"])
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    own_words = F.when(F.col("plain"), cut("p")).when(F.col("kind") == NAMES, cut("w1")).otherwise(cut("w2"))
    found = found.withColumn("words", own_words).withColumn("equal", F.transform("item_words", F.lower) == F.transform("words", F.lower))
    found = found.where(F.when(F.col("plain"), F.col("equal")).when(F.col("kind") == NAMES, cut("t1") == F.col("item_template")).otherwise(cut("t2") == F.col("item_template")))
    pairs = F.when(~F.col("plain"), F.filter(F.arrays_zip("item_template", "item_words", "words"), lambda x: x["item_template"].isin(NUM, NAME, UNIT)))
    lined = found.groupBy("doc_id", "th", "item_id", "kind", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count("*").alias("n_windows"), F.max("n_item").alias("n_item"), F.min("equal").alias("exact"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
        F.count_if(~F.col("plain")).alias("n_alike"), F.max("n_template").alias("n_template"), F.count_if("equal").alias("n_equal"), F.max("several").alias("several"),
    )
    from_item = F.array_distinct(F.transform("slots", lambda x: F.concat(x["item_template"], x["item_words"])))
    enough = (F.col("n_windows") >= F.least(F.lit(min_windows), F.col("n_item"))) | (F.col("n_template") > 0) & (F.col("n_alike") >= F.least(F.lit(min_windows), F.col("n_template")))
    consistent = F.size("slots") == F.size(from_item)
    copied = F.col("n_equal") >= F.when(F.col("several"), min_windows).otherwise(2 * window)
    lined = lined.where(consistent & enough | copied).withColumn("n_windows", F.when(consistent, F.col("n_windows")).otherwise(F.col("n_equal")))
    keys = ["doc_id", F.col("th").alias("text_hash"), "item_id"] if by_text else ["doc_id", "item_id"]
    best = lined.groupBy(*keys).agg(F.max(F.struct("n_windows", "exact", "n_item")).alias("b"))
    return best.select(*best.columns[:-1], F.col("b.n_windows").alias("n_windows"), F.col("b.n_item").alias("n_item"), (F.col("b.n_windows") / F.col("b.n_item")).alias("coverage"), F.col("b.exact").alias("exact"))
