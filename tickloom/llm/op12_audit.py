"""Filter interaction audit: every order of the filters, as paths through a trie whose states are shared.

Filters: A under 50 words; B: 100 * distinct words < 65 * words; C: 100 * A-Z
characters > 5 * code points; D: holds one of #$%&*|; E: text identical to that
of a smaller id, table-wide.

Documents are judged once; a narrow table (part, five flags, two labels) is
stored. The trie of orders is walked depth first: a state is the set of filters
already applied, its rows are the survivors, persisted while its children run.
What survives doesn't depend on the order in which filters came, so the states
are memoised by their sets: 120 orders share 32 states and 80 edges. At every
state one aggregation by part counts what each remaining filter removes from the
survivors; those are the edges. Persisted rows can be lost with an executor:
they are filtered again from the stored table.

E compares SHA-256 digests of whole texts; ids of a digest are reduced before the
shuffle and spread by salt, as in :mod:`tickloom.llm.op13_exact`.

Defined cases: null text is empty; a null source and the empty string are one
part; a null id is neither smaller nor larger than another, so such a row never
fails E nor makes another fail; a document of several label rows is good (toxic)
if one of them says so; repeated rows count each; a table without rows has no
parts and gives none.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tickloom.llm.op13_exact import salt, salt_bit, salts_in, sha256
from tickloom.llm.tables import stored

FILTERS = "ABCDE"


def own_failures(text: Column) -> dict[str, Column]:
    """The filters that need one text only."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def later_copies(marked: DataFrame) -> DataFrame:
    """Adds `E` to rows with `id`, `digest` and `salt`: whether the digest has a smaller id."""
    salted = marked.groupBy("digest", "salt").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    groups = salted.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.bit_or(salt_bit("salt")).alias("salts")).where("n > 1")
    copied = groups.select("digest", F.explode(salts_in("salts")).alias("salt"), "least")
    return marked.join(copied, ["digest", "salt"], "left").withColumn("E", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a document: part, a flag for each filter that it fails, good, toxic."""
    column = lambda c: F.col(f"`{c}`")
    base = docs.select(column(id_col).alias("id"), F.coalesce(column(part_col), F.lit("")).alias("part"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    marked = stored(base.select("id", "part", *[c.alias(f) for f, c in own_failures(F.col("text")).items()], sha256(F.col("text")).alias("digest"), salt(F.col("id")).alias("salt")))
    label = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = later_copies(marked).drop("digest", "salt", "least").join(label, "id", "left")
    return known.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def trie_counts(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(state, part, alive, removed, good_lost, toxic_lost) of every state but the last: arrays by filter, null for those already applied. Parts without survivors have no row."""
    known: dict[frozenset, DataFrame] = {}

    def visit(state: frozenset, survivors: DataFrame) -> None:
        rest = [f for f in filters if f not in state]
        if state in known or not rest:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)

        def by_filter(condition: Column | None = None) -> Column:
            fails = lambda f: F.col(f) if condition is None else F.col(f) & condition
            return F.array(*[F.count_if(fails(f)) if f in rest else F.lit(None).cast("long") for f in filters])

        counts = survivors.groupBy("part").agg(F.count("*").alias("alive"), by_filter().alias("removed"), by_filter(F.col("good")).alias("good_lost"), by_filter(F.col("toxic")).alias("toxic_lost"))
        known[state] = stored(counts.select(F.lit("".join(sorted(state))).alias("state"), "*"))
        for f in rest:
            visit(state | {f}, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), rows)
    out, *more = known.values()
    for df in more:
        out = out.union(df)
    return out


def orders(filters: str = FILTERS) -> Column:
    """A literal array of the steps of all orders: (filter_order, step, state before it, place of its filter in `filters`)."""
    steps = [{"filter_order": "".join(p), "step": k + 1, "state": "".join(sorted(p[:k])), "place": filters.index(p[k])} for p in permutations(filters) for k in range(len(p))]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, state: string, place: int>>")


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order and step; zeros included."""
    counts = trie_counts(stored(judged(docs, labels, **columns)))
    parts = counts.where("state = ''").select("part")
    paths = parts.select("part", F.inline(orders()))
    at = lambda c: F.coalesce(F.get(F.col(c), F.col("place")), F.lit(0).cast("long"))
    edge = paths.join(counts, ["part", "state"], "left").withColumns({"alive": F.coalesce("alive", F.lit(0)), "removed": at("removed"), "good_lost": at("good_lost"), "toxic_lost": at("toxic_lost")})
    same = Window.partitionBy("part", "place")  # the steps of one filter: first in 24 orders, last in 24, each with one state
    return edge.select(
        "part", "filter_order", "step",
        (F.col("alive") - F.col("removed")).alias("kept"), "removed",
        (F.max(F.when(F.col("step") == 1, F.col("removed"))).over(same) - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("step") == len(FILTERS), F.col("removed"))).over(same).alias("unique_fails"),
        "good_lost", "toxic_lost",
        F.sum("removed").over(same).alias("shapley"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(docs, labels)


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 5 * length(d.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least.id THEN 'E' ELSE '' END AS fails
    FROM d JOIN least ON d.t = least.t LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, k::INTEGER AS step, substr(filter_order, k, 1) AS own, string_split(substr(filter_order, 1, k - 1), '') AS before FROM p, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT m.part, s.filter_order, s.step, s.own, m.n, m.good, m.toxic, contains(m.fails, s.own) AS failed, m.fails = s.own AS only_own,
    m.fails <> '' AND list_has_any(string_split(m.fails, ''), s.before) AS gone FROM m, s),
g AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND failed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE only_own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND failed), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND failed), 0)::BIGINT AS toxic_lost
    FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g"""
