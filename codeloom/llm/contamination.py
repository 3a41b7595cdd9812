r"""Benchmark decontamination by template windows; DataFrame operations only.

Texts become template words: numbers, numbers with their unit, and names (runs of
capitalised words other than common function words, wherever they stand) turn into typed
placeholders, everything else is lower-cased, punctuation only separates. The hashes of
all windows of WINDOW template words of the benchmark are joined to those of the
documents. An item is looked for as it is written and, where it has names, in lower case.

Matches of one document, item and reading on one diagonal (same shift between their
places) form an alignment, whose windows are judged one by one. An item's value stands for
the document's value that it meets at most of its places; a window is consistent if its
slots keep to that, and verbatim if they have the item's own values. Two values of the
item may stand for the same value. A document is contaminated by an item if in one
alignment a run of windows over RUN words, or over all of a shorter item, is verbatim, or
is consistent while more than half of the alignment is. So a question with other numbers
and names is caught, a passage with an edited name as well, and a text that merely has the
same shape but ties its slots differently is not.

What templates cannot tell is looked for by its literal lower-cased words: items with
fewer than SHORTEST template words or with windows that are mostly placeholders, and text
in scripts without spaces, letter by letter.

All window sizes of both kinds come from one pass over the documents. The benchmark's
windows are broadcast while they take at most BROADCAST_BYTES, else joined by shuffle
over SALTS salts, after a bitmap has dropped the windows that no item has. Documents'
texts stay where they are read; only matches and their slots are shuffled.

Defined results: null and empty texts match nothing; an item of one word (or one letter of
a script without spaces) is only found as a whole document; repeated items count once;
ties do not matter, as every alignment is judged alone and all items that contaminate are
named; repeated rows have equal results; an empty benchmark or table of documents
contaminates nothing; other columns of either table are not read. A name at an item's end
is no slot, as the document's may go on. n_windows: the longest run, in windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import KeyFilter, materialize, without_keys

WINDOW, RUN, SHORTEST = 8, 13, 5
BROADCAST_BYTES = 64 << 20
SALTS = 16
#: Letters of scripts that are written without spaces; each is a literal word. RUN of them are half as many words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: What counts as a unit directly after a number.
UNITS = "km m cm mm mi ft kg g mg lb lbs oz l ml s sec min h hr hours minutes seconds days weeks months years percent dollars euros usd eur hz khz mhz ghz w kw v j kj cal kcal mph kmh kph".split()
#: Words that begin sentences and are no names.
FUNCTION_WORDS = (
    "about after all also although an and any are as at be because before both but by can consider could describe did do does during each every explain "
    "find for from give given had has have he her here his how if in into is it its let list many may more most must my no not of on one or our she should "
    "since so some such suppose than that the their then there these they this those to two under until was we were what when where which while who whom "
    "whose why will with would write you your"
).split()
NUM, QUANTITY, NAME = "<num>", "<quantity>", "<name>"
#: A number, with its unit if it has one, or a run of letters and digits; for the JVM with loops that give nothing back.
_UNIT = "|".join(UNITS)
TOKEN = rf"[0-9]+(?:[.,][0-9]+)*(?:[ -]?(?i:{_UNIT})\b)?|[\p{{L}}\p{{N}}\p{{M}}]+"
JVM_TOKEN = rf"[0-9]++(?:[.,][0-9]++)*+(?:[ -]?(?i:{_UNIT})(?![\p{{L}}\p{{N}}_]))?|[\p{{L}}\p{{N}}\p{{M}}]++"
CAPITALISED = r"^\p{Lu}\p{Ll}"
#: How an item is read: as written, in lower case, word by word.
WRITTEN, LOWERED, LITERAL = 0, 1, 2
ALIGNMENT = ["key", "item", "reading", "shift"]
_SLOTS = "array<struct<at:int,kind:string,value:string>>"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(JVM_TOKEN), F.lit(0))


def _value(word: Column) -> Column:
    return F.lower(F.translate(word, " -", ""))


def _placeholder(kind: Column) -> Column:
    return kind.isin(NUM, QUANTITY, NAME)


def kinds(words: Column) -> Column:
    """Template words before runs of names become one."""

    def one(x: Column) -> Column:
        return (
            F.when(F.ascii(x).between(48, 57), F.when(F.ascii(F.right(x, F.lit(1))) > 57, QUANTITY).otherwise(NUM))
            .when(x == F.lower(x), x)
            .when(x.rlike(CAPITALISED) & ~F.lower(x).isin(FUNCTION_WORDS), NAME)
            .otherwise(F.lower(x))
        )

    return F.transform(words, one)


def _last_of_run(all_kinds: Column, kind: Column, i: Column) -> Column:
    return (kind != NAME) | (F.coalesce(F.get(all_kinds, i + 1), F.lit("")) != NAME)


def templates(df: DataFrame, text: Column, values: bool = False) -> DataFrame:
    """df with t, the template words of a text; values: and v, the value of each, a name's last word."""
    out = df.withColumn("_words", tokens(text)).withColumn("_kinds", kinds(F.col("_words")))
    if values:
        out = out.withColumn("v", F.filter(F.transform("_words", _value), lambda x, i: _last_of_run(F.col("_kinds"), F.get("_kinds", i), i)))
    return out.withColumn("t", F.filter("_kinds", lambda k, i: _last_of_run(F.col("_kinds"), k, i))).drop("_words", "_kinds")


def literals(text: Column) -> Column:
    """All words lower-cased, without kinds; letters of UNSPACED scripts one by one."""
    return F.transform(tokens(F.regexp_replace(F.coalesce(text, F.lit("")), f"({UNSPACED})", " $1 ")), _value)


def _windows(df: DataFrame, words: str, sizes: list[int], name: str) -> DataFrame:
    """df with columns {name}{size}: hashes of all windows of each size, built from windows of 1, 2, 4 and 8 words."""

    def both(a: Column, b: Column, ahead: int) -> Column:
        n = F.greatest(F.size(b) - ahead, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, ahead + 1, n), lambda x, y: F.xxhash64(x, y))

    out, temporary = df.withColumn("_h1", F.transform(words, lambda x: F.xxhash64(x))), ["_h1"]
    power = 1
    while 2 * power <= max(sizes):
        out = out.withColumn(f"_h{2 * power}", both(F.col(f"_h{power}"), F.col(f"_h{power}"), power))
        power *= 2
        temporary.append(f"_h{power}")
    for size in sizes:
        parts = [p for p in (8, 4, 2, 1) if size & p]
        have, column = parts[0], F.col(f"_h{parts[0]}")
        for i, p in enumerate(parts[1:]):
            out = out.withColumn(f"_p{i}", both(column, F.col(f"_h{p}"), have))
            have, column = have + p, F.col(f"_p{i}")
        out = out.withColumn(f"{name}{size}", column).drop("_p0", "_p1", "_p2")
    return out.drop(*temporary)


def _dense(seen: Column) -> Column:
    return F.size(F.filter(seen, _placeholder)) * 2 > F.size(seen)


def _exploded(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(columns, size, place, hash) of the windows of each row, whose size is in the column size."""
    parts = []
    sizes = sorted(r["size"] for r in df.select("size").distinct().collect())  # WINDOW at most
    for size in sizes or [WINDOW]:
        own = _windows(df.filter(F.col("size") == size), name, [size], "_w")
        parts.append(own.select(*columns, "size", F.posexplode(f"_w{size}").alias("place", "hash")))
    return reduce(DataFrame.unionByName, parts)


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, reading, size, place, ord, hash, needed, slots): every window to look for; ord counts an item's usable windows."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    written = templates(items.withColumn("reading", F.lit(WRITTEN)), F.col("text"), values=True)
    named = written.filter(F.array_contains("t", NAME)).select("item", "text", F.lit(LOWERED).alias("reading"))
    read = materialize(written.unionByName(templates(named, F.lower("text"), values=True)), "templates").withColumn("n", F.size("t")).withColumn("size", F.least("n", F.lit(WINDOW)))

    found = _exploded(read.filter(F.col("n") >= SHORTEST), ["item", "reading", "t", "v", "n"], "t")
    found = found.filter(~_dense(F.slice("t", F.col("place") + 1, F.col("size"))))
    inside = lambda at: (at >= F.col("place")) & (at < F.col("place") + F.col("size"))
    slots = F.zip_with("t", "v", lambda k, v: F.struct(k.alias("kind"), v.alias("value")))
    slots = F.filter(F.transform(slots, lambda s, i: F.struct(i.alias("at"), s["kind"].alias("kind"), s["value"].alias("value"))), lambda s: inside(s["at"]) & _placeholder(s["kind"]) & ((s["kind"] != NAME) | (s["at"] < F.col("n") - 1)))
    found = found.select("item", "reading", "size", "place", "hash", slots.cast(_SLOTS).alias("slots"), F.lit(RUN - WINDOW + 1).alias("most"))

    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - F.col("size") + 1, F.lit(1)))
    unspaced = F.col("text").rlike(UNSPACED)
    hard = (F.col("n") < SHORTEST) | F.exists(starts, lambda i: _dense(F.slice("t", i, F.col("size")))) | unspaced
    plain = read.filter((F.col("reading") == WRITTEN) & hard).select("item", F.lit(LITERAL).alias("reading"), literals(F.col("text")).alias("l"), F.when(unspaced, 2 * RUN).otherwise(RUN).alias("run"))
    plain = materialize(plain.filter(F.size("l") > 0), "literals").withColumn("size", F.least(F.size("l"), F.lit(WINDOW)))
    plain = _exploded(plain, ["item", "reading", "run"], "l")
    plain = plain.select("item", "reading", "size", "place", "hash", F.array().cast(_SLOTS).alias("slots"), (F.col("run") - WINDOW + 1).alias("most"))

    item = Window.partitionBy("item", "reading")
    every = found.unionByName(plain).withColumn("ord", F.row_number().over(item.orderBy("place")))
    return every.withColumn("needed", F.greatest(F.least(F.count("*").over(item), F.col("most")), F.lit(1))).drop("most")


def _matches(rows: DataFrame, look: DataFrame) -> DataFrame:
    """(alignment, ord, needed, slots) of every window of the rows that an item has; one pass over the texts."""
    literal = F.col("reading") == LITERAL
    segments = sorted((bool(r["literal"]), r["size"]) for r in look.select(literal.alias("literal"), "size").distinct().collect())  # 2 * WINDOW at most
    sizes = {kind: [n for k, n in segments if k == kind] for kind in (False, True)}
    texts = rows.select("key", "text")
    if sizes[False]:
        texts = _windows(templates(texts, F.col("text")), "t", sizes[False], "_t")
    if sizes[True]:
        texts = _windows(texts.withColumn("l", literals(F.col("text"))), "l", sizes[True], "_l")
    names = [f"_{'l' if k else 't'}{n}" for k, n in segments]
    counted = texts.select("key", *(F.size(c).alias(f"n{i}") for i, c in enumerate(names)), F.concat(*names).alias("_all"))
    # Outer, as the filter that Spark infers for a plain explode would compute the arrays once more.
    windows = counted.select("key", *(f"n{i}" for i in range(len(names))), F.posexplode_outer("_all").alias("pos", "hash"))

    weight = look.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("slots")), F.lit(0)).alias("slots")).first()
    if 100 * weight["rows"] + 80 * weight["slots"] <= BROADCAST_BYTES:
        hits = windows.join(F.broadcast(look), "hash")
    else:
        windows = KeyFilter(look, F.col("hash")).mark(windows, F.col("hash"), "maybe").filter("maybe").drop("maybe")
        windows = windows.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
        hits = windows.join(look.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hash", "salt"])
    # Where a window stands within the arrays of its own kind and size.
    at, count = F, F
    for i, (kind, size) in enumerate(segments):
        here = (literal == F.lit(kind)) & (F.col("size") == size)
        before = reduce(lambda a, b: a + b, (F.col(f"n{j}") for j in range(i)), F.lit(0))
        at, count = at.when(here, F.col("pos") - before), count.when(here, F.col(f"n{i}"))
    hits = hits.select("*", at.alias("at"), count.alias("own")).filter("at >= 0 AND at < own AND (size > 1 OR own = 1)")
    return hits.select("key", "item", "reading", (F.col("at") - F.col("place")).alias("shift"), "ord", "needed", "slots").distinct()


def _slot_marks(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(alignment, torn, changed): places in the document whose value is not what the item's value stands for, or not the item's."""
    open_slots = found.filter(F.size("slots") > 0)
    wanted = materialize(open_slots.select("key").distinct(), "with-slots")
    source = KeyFilter(wanted, F.col("key")).mark(rows, F.col("key"), "maybe").filter("maybe").join(wanted, "key", "left_semi")
    source = templates(source.select("key", "text"), F.col("text"), values=True)
    placed = F.transform(F.arrays_zip("t", "v"), lambda s, i: F.struct(i.alias("at"), s["t"].alias("kind"), s["v"].alias("theirs")))
    theirs = source.select("key", F.inline(F.filter(placed, lambda s: _placeholder(s["kind"])))).select("key", "at", "theirs").distinct()
    ours = open_slots.select(*ALIGNMENT, F.inline("slots")).select(*ALIGNMENT, (F.col("at") + F.col("shift")).alias("at"), "kind", F.col("value").alias("ours"))
    pairs = ours.join(theirs, ["key", "at"]).groupBy(*ALIGNMENT, "kind", "ours", "theirs").agg(F.collect_set("at").alias("ats"))
    said = pairs.groupBy(*ALIGNMENT, "kind", "ours").agg(F.sum(F.size("ats")).alias("all"), F.collect_list(F.struct("theirs", "ats")).alias("said"))

    def places(keep) -> Column:
        return F.flatten(F.transform(F.filter("said", keep), lambda v: v["ats"]))

    torn, changed = places(lambda v: F.size(v["ats"]) * 2 <= F.col("all")), places(lambda v: v["theirs"] != F.col("ours"))
    marks = said.select(*ALIGNMENT, torn.alias("torn"), changed.alias("changed")).filter("size(changed) > 0").groupBy(*ALIGNMENT)
    return marks.agg(F.flatten(F.collect_list("torn")).alias("torn"), F.flatten(F.collect_list("changed")).alias("changed"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(key, item, n_windows) of every item that contaminates; key: see keyed()."""
    rows = keyed(docs, id_col, text_col)
    look = materialize(benchmark_windows(benchmark, item_col, text_col), "benchmark-windows")
    if look.isEmpty():
        return rows.select("key", F.lit(None).cast("long").alias("item"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    found = materialize(_matches(rows, look), "matches")

    own = F.transform("slots", lambda s: s["at"] + F.col("shift"))
    judged = found.join(materialize(_slot_marks(found, rows), "slot-pairs"), ALIGNMENT, "left")
    keeps = lambda places: ~F.coalesce(F.arrays_overlap(own, places), F.lit(False))
    judged = judged.select(*ALIGNMENT, "ord", "needed", keeps("torn").alias("consistent"), keeps("changed").alias("verbatim"))
    # An alignment has as many windows as its item at most.
    whole = Window.partitionBy(*ALIGNMENT)
    judged = judged.withColumn("mostly", F.count_if("consistent").over(whole) * 2 > F.count("*").over(whole))
    how = F.filter(F.array(F.when(F.col("consistent") & F.col("mostly"), "consistent"), F.when(F.col("verbatim"), "verbatim")), lambda h: h.isNotNull())
    runs = judged.select(*ALIGNMENT, "ord", "needed", F.explode(how).alias("how"))
    run = F.col("ord") - F.row_number().over(Window.partitionBy(*ALIGNMENT, "how").orderBy("ord"))
    runs = runs.withColumn("run", run).groupBy(*ALIGNMENT, "how", "run").agg(F.count("*").alias("n"), F.max("needed").alias("needed"))
    return runs.filter("n >= needed").groupBy("key", "item").agg(F.max("n").alias("n_windows"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key): rows of equal id and text share a key and hence a verdict."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, contaminated, n_windows, items) for each row; items: ids of the items, ascending, comma-joined."""
    found = contamination(docs, benchmark, id_col, text_col, item_col)
    by_key = found.groupBy("key").agg(F.max("n_windows").alias("n_windows"), F.array_join(F.array_sort(F.collect_set("item")).cast("array<string>"), ",").alias("items"))
    out = keyed(docs, id_col, text_col).select("id", "key").join(materialize(by_key, "contaminated"), "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("items", F.lit("")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the rows that an item contaminates."""
    gone = materialize(contamination(docs, benchmark, id_col, text_col, item_col).select("key").distinct(), "contaminated")
    return without_keys(docs, gone, F.xxhash64(F.col(id_col), F.col(text_col)))


def _listed(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SQL_UNSPACED = UNSPACED.replace("{Is", "{")


def _sql_template(rows: str) -> str:
    """(columns of rows, t, v) from rows with a text."""
    return f"""
  SELECT * EXCLUDE (words, kinds, ix), list_transform(ix, lambda i: kinds[i]) AS t, list_transform(ix, lambda i: lower(translate(words[i], ' -', ''))) AS v
  FROM (SELECT *, list_filter(range(1, len(kinds) + 1), lambda i: kinds[i] <> '{NAME}' OR coalesce(kinds[i + 1], '') <> '{NAME}') AS ix
    FROM (SELECT *, list_transform(words, lambda x: CASE
        WHEN x[1] BETWEEN '0' AND '9' THEN CASE WHEN x[-1] BETWEEN '0' AND '9' THEN '{NUM}' ELSE '{QUANTITY}' END
        WHEN regexp_matches(x, '{CAPITALISED}') AND lower(x) NOT IN ({_listed(FUNCTION_WORDS)}) THEN '{NAME}'
        ELSE lower(x) END) AS kinds
      FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS words FROM {rows})))"""


_SQL_PLACEHOLDERS = _listed((NUM, QUANTITY, NAME))
ORACLE_SQL = f"""
WITH items AS (SELECT DISTINCT item_id, text FROM benchmark),
b0 AS ({_sql_template(f"(SELECT item_id, {WRITTEN} AS reading, text FROM items)")}),
b1 AS ({_sql_template(f"(SELECT item_id, {LOWERED} AS reading, lower(text) AS text FROM b0 WHERE list_contains(t, '{NAME}'))")}),
b AS (SELECT *, len(t) AS n, least(len(t), {WINDOW}) AS size FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1)),
bw AS (SELECT *, unnest(range(1, n - size + 2)) AS i FROM b),
bx AS (SELECT *, t[i:i + size - 1] AS s, 2 * len(list_filter(t[i:i + size - 1], lambda k: k IN ({_SQL_PLACEHOLDERS}))) > size AS dense FROM bw),
hard AS (SELECT item_id, text FROM b0 WHERE len(t) < {SHORTEST} OR regexp_matches(text, '{_SQL_UNSPACED}') OR item_id IN (SELECT item_id FROM bx WHERE reading = {WRITTEN} AND dense)),
l AS (SELECT item_id, CASE WHEN regexp_matches(text, '{_SQL_UNSPACED}') THEN {2 * RUN} ELSE {RUN} END AS run,
      list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '({_SQL_UNSPACED})', ' \\1 ', 'g'), '{TOKEN}'), lambda x: lower(translate(x, ' -', ''))) AS t FROM hard),
lw AS (SELECT *, least(len(t), {WINDOW}) AS size, unnest(range(1, len(t) - least(len(t), {WINDOW}) + 2)) AS i FROM l WHERE len(t) > 0),
look AS (SELECT *, row_number() OVER (PARTITION BY item_id, reading ORDER BY i) AS ord, greatest(least(count(*) OVER (PARTITION BY item_id, reading), most), 1) AS needed FROM (
    SELECT item_id, reading, size, i, s, v[i:i + size - 1] AS ours, n, {RUN - WINDOW + 1} AS most FROM bx WHERE n >= {SHORTEST} AND NOT dense
    UNION ALL SELECT item_id, {LITERAL}, size, i, t[i:i + size - 1], t[i:i + size - 1], len(t), run - {WINDOW - 1} FROM lw)),
z AS (SELECT DISTINCT reading = {LITERAL} AS literal, size FROM look),
d AS (SELECT doc_id, false AS literal, t, v FROM ({_sql_template("documents")})
      UNION ALL SELECT doc_id, true, t, t FROM (SELECT doc_id,
        list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '({_SQL_UNSPACED})', ' \\1 ', 'g'), '{TOKEN}'), lambda x: lower(translate(x, ' -', ''))) AS t FROM documents)
      WHERE EXISTS (SELECT 1 FROM z WHERE z.literal)),
dw AS (SELECT d.doc_id, d.literal, size, t, v, unnest(range(1, len(t) - size + 2)) AS j FROM d JOIN z ON z.literal = d.literal WHERE len(t) >= size AND (size > 1 OR len(t) = 1)),
m AS (SELECT doc_id, item_id, reading, j - i AS shift, i, ord, needed, n, look.size, s, ours, v[j:j + look.size - 1] AS theirs
      FROM dw JOIN look ON look.size = dw.size AND (look.reading = {LITERAL}) = dw.literal AND look.s = dw.t[j:j + dw.size - 1]),
p AS (SELECT DISTINCT doc_id, item_id, reading, shift, y, kind, o, h
      FROM (SELECT doc_id, item_id, reading, shift, n, unnest(range(i, i + size)) AS y, unnest(s) AS kind, unnest(ours) AS o, unnest(theirs) AS h FROM m WHERE reading <> {LITERAL})
      WHERE kind IN ({_SQL_PLACEHOLDERS}) AND (kind <> '{NAME}' OR y < n)),
q AS (SELECT *, o <> h AS changed, 2 * count(*) OVER (PARTITION BY doc_id, item_id, reading, shift, kind, o, h) <= count(*) OVER (PARTITION BY doc_id, item_id, reading, shift, kind, o) AS torn FROM p),
j AS (SELECT m.doc_id, m.item_id, m.reading, m.shift, m.ord, m.needed, NOT coalesce(bool_or(q.torn), false) AS consistent, NOT coalesce(bool_or(q.changed), false) AS verbatim
      FROM m LEFT JOIN q ON q.doc_id = m.doc_id AND q.item_id = m.item_id AND q.reading = m.reading AND q.shift = m.shift AND q.y BETWEEN m.i AND m.i + m.size - 1
      GROUP BY ALL),
k AS (SELECT *, 2 * count_if(consistent) OVER a > count(*) OVER a AS mostly FROM j WINDOW a AS (PARTITION BY doc_id, item_id, reading, shift)),
r AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id, item_id, reading, shift, how ORDER BY ord) AS run FROM (
      SELECT *, 'consistent' AS how FROM k WHERE consistent AND mostly UNION ALL SELECT *, 'verbatim' FROM k WHERE verbatim)),
f AS (SELECT doc_id, item_id, count(*) AS n FROM r GROUP BY doc_id, item_id, reading, shift, how, run HAVING count(*) >= max(needed)),
v AS (SELECT doc_id, max(n) AS n_windows, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM f GROUP BY doc_id)
SELECT documents.doc_id, v.items IS NOT NULL AS contaminated, coalesce(v.n_windows, 0) AS n_windows, coalesce(v.items, '') AS items
FROM documents LEFT JOIN v ON v.doc_id = documents.doc_id
"""
