"""Mixing sources to target weights by a hierarchical token budget.

The tree is domain - language - source; a leaf is one of its paths that holds rows. A node's budget is dealt to its
children by weight. A child whose subtree can't use its share (all its tokens, max_epochs times) gets what it can use,
and what it leaves is dealt to its siblings by weight. As a subtree's capacity is that of all its leaves, a shortage
is met by siblings first and reaches an ancestor's siblings only when a whole subtree is used up.

A leaf takes whole epochs of its rows while its budget lasts, then the prefix of one more epoch whose tokens fit. Each
epoch has its own order: a seeded hash of the id. The prefix ends at a key that is found from exact token sums over
4096 ranges of the hash and, within the one range that holds the end, a running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.llm.storage import Scratch

LEVELS = ("domain", "language", "source")
#: Leaves up to this number are planned as a broadcast table; beyond, by a join.
BROADCAST_LEAVES = 50_000


def fill(amount: float, children: dict, capacity: dict) -> dict:
    """Deal an amount to children by weight, none above its capacity; what one can't use goes to the others."""
    out = {c: 0.0 for c in children}
    open_ = {c for c in children if children[c] > 0 and capacity[c] > 0}
    left = min(amount, sum(capacity[c] for c in open_))
    while open_ and left > 1e-9:
        weight = sum(children[c] for c in open_)
        full = {c for c in open_ if capacity[c] - out[c] <= left * children[c] / weight}
        if not full:
            for c in open_:
                out[c] += left * children[c] / weight
            break
        for c in sorted(full, key=str):
            left -= capacity[c] - out[c]
            out[c] = float(capacity[c])
        open_ -= full
    return out


def budgets(tokens: dict[tuple, int], total: float, weights: list[dict], max_epochs: int) -> dict[tuple, int]:
    """Each leaf's budget. tokens: of the leaves (paths of one length); weights: for each level a dict from a node's
    name to its weight among its siblings (1 where it has none). One pass up for capacities, one down for shares."""
    capacity: dict[tuple, int] = {}
    children: dict[tuple, set] = {}
    for path, t in tokens.items():
        for depth in range(len(path) + 1):
            capacity[path[:depth]] = capacity.get(path[:depth], 0) + max_epochs * t
            if depth:
                children.setdefault(path[: depth - 1], set()).add(path[depth - 1])
    out: dict[tuple, int] = {}
    waiting = [((), total)] if tokens else []
    while waiting:
        node, amount = waiting.pop()
        if node not in children:
            out[node] = int(amount)
            continue
        names = sorted(children[node], key=lambda x: (x is None, x))
        shares = fill(amount, {c: float(weights[len(node)].get(c, 1.0)) for c in names}, {c: capacity[(*node, c)] for c in names})
        waiting += [((*node, c), shares[c]) for c in names]
    return out


def count_tokens(text: Column) -> Column:
    """Words of a text: runs other than white space; none for null."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.coalesce((F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)), F.lit(0)).cast("bigint")


def _order(seed: int, epoch: Column, key: str) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col(key))


def mix_sources(
    docs: DataFrame, domain: Column, weights: list[dict], fraction: float = 1.0, max_epochs: int = 1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", source_col: str = "source", scratch: Scratch | None = None
) -> DataFrame:
    """The chosen rows of docs, once for every epoch that takes them: all columns and `epoch`, `tokens`, `domain` (which
    replace input columns of these names).

    The budget is `fraction` of the tokens of all rows. A null domain, language or source is a node of its own; a null
    text has no tokens and is taken with its neighbours in the order; a leaf that holds no tokens at all has no budget and
    gives no rows. Rows of one id in a leaf (or of no id) are taken together, and have one place in the order. An empty
    table gives no rows. Budgets are dealt on the driver from one row a leaf: domains times languages times sources, which
    grow with the sources but never with the documents."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    # the rows' own columns travel as one struct, so no name of theirs meets one of this module
    carried = [c for c in docs.columns if c not in ("epoch", "tokens", "domain")]
    own = [domain, F.col(f"`{language_col}`"), F.col(f"`{source_col}`")]
    keys = [f"_{n}" for n in LEVELS]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("kept"), *[c.alias(k) for c, k in zip(own, keys, strict=True)], F.col(f"`{id_col}`").alias("_id"), count_tokens(F.col(f"`{text_col}`")).alias("tokens"))
    narrow = scratch.save(base.select(*keys, "_id", "tokens"), "tokens")
    totals = {tuple(r[k] for k in keys): r["t"] for r in narrow.groupBy(*keys).agg(F.sum("tokens").alias("t")).collect()}
    plan = budgets(totals, fraction * sum(totals.values()), weights, max_epochs)

    rows = [(*p, *(divmod(b, totals[p]) if totals[p] else (1 if b else 0, 0))) for p, b in plan.items()]
    kinds = [narrow.schema[k].dataType.simpleString() for k in keys]
    plans = spark.createDataFrame(rows, ", ".join([*(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)), "_whole bigint", "_rest bigint"]))
    small = F.broadcast if len(rows) <= BROADCAST_LEAVES else (lambda x: x)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]

    part = narrow.alias("n").join(small(plans), same(narrow, plans)).filter("_rest > 0")
    part = part.select(*[narrow[k] for k in keys], "_id", "tokens", "_rest", _order(seed, F.col("_whole"), "_id").alias("_k"))
    part = part.withColumn("_bin", F.shiftright("_k", 52))
    bins = part.groupBy(*keys, "_rest", "_bin").agg(F.sum("tokens").alias("t"))
    upto = bins.withColumn("_sum", F.sum("t").over(Window.partitionBy(*keys).orderBy("_bin")))
    cut = upto.filter("_sum > _rest").groupBy(*keys).agg(F.min(F.struct("_bin", (F.col("_sum") - F.col("t")).alias("_below"))).alias("c")).select(*keys, "c._bin", "c._below")
    cut = scratch.save(cut, "cut")
    end = part.join(small(cut), [*same(part, cut), part["_bin"] == cut["_bin"]]).select(*[part[k] for k in keys], "_k", "_id", "tokens", "_below", "_rest")
    end = end.groupBy(*keys, "_k", "_id", "_below", "_rest").agg(F.sum("tokens").alias("t"))
    end = end.withColumn("_sum", F.col("_below") + F.sum("t").over(Window.partitionBy(*keys).orderBy("_k", "_id")))
    end = end.filter("_sum <= _rest").groupBy(*keys).agg(F.max(F.struct("_k", "_id")).alias("m"))
    ends = cut.join(end, [cut[k].eqNullSafe(end[k]) for k in keys], "left").select(*[cut[k] for k in keys], F.lit(True).alias("_cut"), F.col("_bin").alias("_cutbin"), F.col("m._k").alias("_lastk"), F.col("m._id").alias("_lastid"))
    full = plans.join(ends, same(plans, ends), "left").select(*[plans[k] for k in keys], "_whole", "_rest", "_cut", "_cutbin", "_lastk", "_lastid")
    full = scratch.save(full.coalesce(1), "plan")

    joined = base.join(small(full), same(base, full)).select("kept", base["_domain"], "_id", "tokens", "_whole", "_rest", "_cut", "_cutbin", "_lastk", "_lastid")
    k = _order(seed, F.col("_whole"), "_id")
    before = (F.shiftright(k, 52) < F.col("_cutbin")) | (k < F.col("_lastk"))
    before = before | ((k == F.col("_lastk")) & (F.col("_id").eqNullSafe(F.col("_lastid")) | (F.col("_id") < F.col("_lastid"))))
    partial = (F.col("_rest") > 0) & (F.col("_cut").isNull() | F.coalesce(before, F.lit(False)))
    times = F.col("_whole") + partial.cast("bigint")
    out = joined.withColumn("_times", times).filter("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)))
    return out.select(*[F.col("kept")[c].alias(c) for c in carried], "tokens", F.col("_domain").alias("domain"), "epoch")
