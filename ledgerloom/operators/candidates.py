"""Candidate generation: three bank tiers, invoices by id, ambiguity evidence.

Every settlement is an anchor and stays exactly one row. A candidate set is a *group* of bank rows
(all rows of one UTR, of one transaction id, or of one narration inside the gate), so groups are
summarised once and anchors look the summary up; anchor-candidate pairs are never enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.narration import similar_pairs
from ledgerloom.operators import blocking
from ledgerloom.operators.gates import gate_join, in_gate, point_cells, query_cells
from ledgerloom.operators.nearest import nearest
from ledgerloom.operators.skew import lookup, lookups, only, way_of
from ledgerloom.session import stage

BANK_ROW = ("src_pos", "bank_ref", "txn_id", "utr", "amount", "day", "narration")
INVOICE_ROW = ("src_pos", "invoice_id", "txn_id", "amount", "fee", "gst", "tds", "day")


def _identity() -> Column:
    """What makes two rows the same financial event; amount and day lead, so that two extremes also tell whether these vary."""
    return F.struct("amount", "day", "txn_id", "utr")


def prepared_bank(bank: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return bank.select(
        *scope,
        *BANK_ROW,
        F.coalesce("utr", F.lit("")).alias("tie"),
        F.struct(*BANK_ROW).alias("row"),
    )


def prepared_invoices(invoice: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return invoice.select(
        *scope,
        *INVOICE_ROW,
        F.lit(None).cast("string").alias("utr"),
        F.lit("").alias("tie"),
        F.struct(*INVOICE_ROW).alias("row"),
    )


def summarise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: size, first row by (tie, position), duplicate and uniformity flags; keys are present.

    ``uniform`` groups share one (amount, day), so their winner does not depend on the anchor; ``one_txn`` ones also share
    their transaction id or have none. A group is shuffled as its first row and its two extremes, each without the key,
    and nothing twice. Grouped the way ``lookup`` joins them, so the groups are shuffled once.
    """
    row = rows.schema["row"].dataType.names
    order = ("tie", "src_pos") if "utr" not in keys else ("src_pos",)
    held = [c for c in row if c not in (*order, *keys)]
    identity = F.struct(*[c for c in ("amount", "day", "txn_id", "utr") if c not in keys])
    grouped = rows.withColumn("_way", way_of(keys)).groupBy(*keys, "_way").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(*order, *held)).alias("first"),
        F.min(identity).alias("low"),
        F.max(identity).alias("high"),
    )
    one_amount = F.col("low.amount").eqNullSafe(F.col("high.amount"))
    uniform = one_amount & F.col("low.day").eqNullSafe(F.col("high.day"))
    one_txn = uniform & (F.lit(True) if "txn_id" in keys else F.col("low.txn_id").eqNullSafe(F.col("high.txn_id")))
    return grouped.select(
        *keys,
        "_way",
        F.struct(
            "n",
            F.struct(*[(F.col(c) if c in keys else F.col(f"first.{c}")).alias(c) for c in row]).alias("row"),
            ((F.col("n") >= 2) & F.col("low").eqNullSafe(F.col("high"))).alias("duplicate"),
            uniform.alias("uniform"),
            one_amount.alias("one_amount"),
            one_txn.alias("one_txn"),
        ).alias("group"),
    )


def _present(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def with_keys(pg: DataFrame) -> DataFrame:
    """Anchors with their lookup keys; an empty reference counts as missing."""
    return pg.withColumn("utr_key", F.nullif("utr", F.lit(""))).withColumn("txn_key", F.nullif("txn_id", F.lit("")))


def match_exact_utr(pg: DataFrame, bank: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Tier 1: anchors with the group of bank rows carrying their UTR, in column ``u``; its rows leave the UTR, which is the
    anchor's, out."""
    groups = summarise(prepared_bank(bank, scope).filter(_present("utr")), [*scope, "utr"])
    groups = groups.withColumn("group", F.col("group").withField("row", F.col("group.row").dropFields("utr")))
    groups = groups.withColumnsRenamed({"utr": "utr_key", "group": "u"})
    return lookup(with_keys(pg).drop("txn_key"), groups, [*scope, "utr_key"], "src_pos").drop("utr_key")


def _txn_groups(bank: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    groups = summarise(prepared_bank(bank, scope).filter(_present("txn_id")), [*scope, "txn_id"])
    return groups.withColumnsRenamed({"txn_id": "txn_key", "group": "t"})


def _invoice_groups(invoice: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    groups = summarise(prepared_invoices(invoice, scope).filter(_present("txn_id")), [*scope, "txn_id"])
    return groups.withColumnsRenamed({"txn_id": "txn_key", "group": "i"})


def match_exact_txn(pg: DataFrame, bank: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Bank rows resolving to the anchor's transaction id, in column ``t``: tier 2 where tier 1 missed,
    and otherwise the rows that can never be rivals."""
    return lookup(pg, _txn_groups(bank, scope), [*scope, "txn_key"], "src_pos")


def match_invoices(pg: DataFrame, invoice: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Invoices by exact transaction id only, in column ``i``."""
    return lookup(pg, _invoice_groups(invoice, scope), [*scope, "txn_key"], "src_pos")


def exact_groups(
    pg: DataFrame, bank: DataFrame, invoice: DataFrame, scope: tuple[str, ...] = ()
) -> DataFrame:
    """Anchors with their UTR group, transaction group and invoice group, and what is still open."""
    joined = match_exact_utr(pg, bank, scope)
    by_id = [_txn_groups(bank, scope), _invoice_groups(invoice, scope)]
    # a key joins the anchors only where they are dealt by it
    joined = lookups(joined.withColumn("txn_key", F.nullif("txn_id", F.lit(""))), by_id, [*scope, "txn_key"], "src_pos")
    t = F.col("t.row")
    # a row of the transaction is kept only where it can win; where it lies in the gate matters of any
    winner = F.when(F.col("u").isNull(), t)
    kept = F.col("t").withField("row", winner).withField("amount", t["amount"]).withField("day", t["day"])
    joined = with_keys(joined).withColumn("t", F.when(F.col("t").isNotNull(), kept))
    u = F.col("u.row")
    whole = F.struct(*[(F.col("utr_key") if c == "utr" else u[c]).alias(c) for c in BANK_ROW])
    joined = joined.withColumn("u", F.when(F.col("u").isNotNull(), F.col("u").withField("row", whole)))
    by_utr, by_txn = F.col("u").isNotNull(), F.col("t").isNotNull()
    u_split, t_split = ~F.col("u.uniform"), ~F.col("t.uniform")
    return joined.select(
        "*",
        F.when(by_utr, "exact_utr").when(by_txn, "exact_txn").alias("exact_tier"),
        F.coalesce(F.when(by_utr, u_split).when(by_txn, t_split), F.lit(False)).alias("pick_bank"),
        F.coalesce(~F.col("i.one_amount"), F.lit(False)).alias("pick_invoice"),
        F.coalesce(
            F.when(by_utr, u_split | ~F.col("u.one_txn") | F.coalesce(t_split, F.lit(False))).when(by_txn, t_split),
            F.lit(False),
        ).alias("count_own"),
    )


# --- ambiguity -----------------------------------------------------------------------------


def gate_totals(pg: DataFrame, bank: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Bank rows inside the gate of each distinct (expected net, day)."""
    asked = pg.select(*scope, "expected_net", "day").distinct()
    points = bank.groupBy(*scope, "amount", F.col("day").alias("bank_day")).agg(F.count(F.lit(1)).alias("n"))
    return (
        gate_join(asked, points, list(scope))
        .groupBy(*scope, "expected_net", "day")
        .agg(F.sum("n").alias("in_gate"))
    )


def _own_uniform() -> Column:
    """Rows inside the gate that are the anchor's own, when its groups are uniform."""

    def inside(g: str, at: str) -> Column:
        ok = in_gate(F.col("expected_net"), F.col("day"), F.col(f"{at}.amount"), F.col(f"{at}.day"))
        return F.coalesce(F.when(ok, F.col(f"{g}.n")), F.lit(0))

    by_utr, by_txn = inside("u", "u.row"), inside("t", "t")
    shared = F.when(F.col("u.row.txn_id").eqNullSafe(F.col("txn_key")) & F.col("txn_key").isNotNull(), by_utr)
    return F.when(F.col("u").isNotNull(), by_utr + by_txn - F.coalesce(shared, F.lit(0))).otherwise(by_txn)


def own_in_gate(anchors: DataFrame, bank: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The same count for anchors whose groups mix days, amounts or ids: (scope, src_pos, own).

    Rows of the anchor's UTR group, plus rows of its transaction outside that group.
    """
    asked = anchors.select(
        *scope,
        "src_pos",
        "expected_net",
        "day",
        F.when(F.col("u").isNotNull(), F.col("utr_key")).alias("utr_key"),
        "txn_key",
    )
    points = bank.select(
        *scope, F.col("utr").alias("utr_key"), F.col("txn_id").alias("txn_key"), "amount", F.col("day").alias("bank_day")
    )

    def with_count(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Rows inside the gate that carry ``keys``, counted once for each distinct question."""
        present = " and ".join(f"{k} is not null" for k in keys)
        question = [*scope, "expected_net", "day", *keys]
        grouped = points.filter(present).groupBy(*scope, *keys, "amount", "bank_day").agg(F.count(F.lit(1)).alias("n"))
        counted = gate_join(asked.filter(present).select(*question).distinct(), grouped, [*scope, *keys])
        return lookup(rows, counted.groupBy(*question).agg(F.sum("n").alias(name)), question, "src_pos")

    # in the transaction but not in the UTR group = in the transaction - in both: no pairs that differ in a key
    out = with_count(asked, ["utr_key"], "_utr")
    out = with_count(out, ["txn_key"], "_txn")
    out = with_count(out, ["utr_key", "txn_key"], "_both")
    own = F.coalesce("_utr", F.lit(0)) + F.coalesce("_txn", F.lit(0)) - F.coalesce("_both", F.lit(0))
    return out.select(*scope, "src_pos", own.alias("own"))


# --- tier 3 --------------------------------------------------------------------------------


def near_rows(open_keys: DataFrame, bank: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Bank rows sharing a gate cell with some open anchor. There are up to six cells for each, from files that compress well,
    so their number decides how they are joined, not the planner's guess."""
    cells = [*scope, "_paise", "_week"]
    near = only(point_cells(bank.select(*scope, *BANK_ROW), day="day"), query_cells(open_keys), cells)
    return prepared_bank(near, scope)


def fuzzy_points(open_keys: DataFrame, bank: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Those rows with copies collapsed to (amount, day, narration)."""
    return near_rows(open_keys, bank, scope).groupBy(
        *scope, "amount", F.col("day").alias("bank_day"), F.coalesce("narration", F.lit("")).alias("text")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(_identity()).alias("low"),
        F.max(_identity()).alias("high"),
        F.min(F.struct("tie", "src_pos", "row")).alias("first"),
    )


def scored_pairs(open_keys: DataFrame, points: DataFrame, scope: tuple[str, ...], floor: int) -> DataFrame:
    """Gated (reference, narration) pairs with their similarity, kept at or above ``floor``.

    A pair is its texts and gate values; what else a point holds is looked up for the pairs that are kept.
    """
    point = [*scope, "text", "amount", "bank_day"]
    pairs = blocking.gated_pairs(open_keys, points.select(*point), scope, floor)
    return similar_pairs(pairs, "ref", "text", floor).join(points, point)


def open_keys_of(anchors: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return anchors.select(*scope, F.coalesce("utr", F.lit("")).alias("ref"), "expected_net", "day").distinct()


def match_fuzzy(anchors: DataFrame, bank: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Tier 3 for anchors both exact tiers missed: (scope, src_pos, f).

    Amount and date are gates; similarity alone never matches. Anchors asking the same question
    share one answer.
    """
    asked = open_keys_of(anchors, scope)
    # both are read for the cell sizes and again for the pairs
    asked = stage(asked, "fuzzy-asked")
    points = stage(fuzzy_points(asked, bank, scope), "fuzzy-points")
    hits = scored_pairs(asked, points, scope, C.FUZZY_MIN_SIMILARITY)
    key = ["ref", "expected_net", "day"]
    groups = hits.groupBy(*scope, *key).agg(
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min(
            F.struct(
                F.abs(F.datediff("bank_day", "day")).alias("days"),
                F.abs(F.col("expected_net") - F.col("amount")).alias("apart"),
                "first",
            )
        ).alias("win"),
    )
    answers = groups.select(
        *scope,
        *key,
        F.struct(
            "n",
            F.col("win.first.row").alias("row"),
            ((F.col("n") >= 2) & F.col("low").eqNullSafe(F.col("high"))).alias("duplicate"),
        ).alias("f"),
    )
    narrow = anchors.select(*scope, "src_pos", F.coalesce("utr", F.lit("")).alias("ref"), "expected_net", "day")
    return lookup(narrow, answers, [*scope, *key], "src_pos", "inner").select(*scope, "src_pos", "f")


# --- assembly ------------------------------------------------------------------------------


def _bank_winners(anchors: DataFrame, bank: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Winners for anchors whose group mixes days or amounts: (scope, src_pos, bank_pick)."""
    rows = prepared_bank(bank, scope)
    parts = []
    for tier, key, column in (("exact_utr", "utr_key", "utr"), ("exact_txn", "txn_key", "txn_id")):
        mine = anchors.filter(F.col("exact_tier") == tier)
        asked = mine.select(*scope, "src_pos", key, "day", F.col("expected_net").alias("target"))
        pool = only(rows.withColumn(key, F.col(column)), asked, [*scope, key])
        best = nearest(asked, pool, [*scope, key], "tie", "row")
        parts.append(
            lookup(asked, best, [*scope, key, "day", "target"], "src_pos", "inner").select(
                *scope, "src_pos", F.col("row").alias("bank_pick")
            )
        )
    return parts[0].unionByName(parts[1])


def _invoice_winners(anchors: DataFrame, invoice: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """The same for invoices, by amount alone: (scope, src_pos, invoice_pick)."""
    same_day = F.lit("1970-01-01").cast("date")
    asked = anchors.select(
        *scope, "src_pos", "txn_key", same_day.alias("day"), F.col("expected_invoice").alias("target")
    )
    bills = prepared_invoices(invoice, scope).withColumn("txn_key", F.col("txn_id")).withColumn("day", same_day)
    pool = only(bills, asked, [*scope, "txn_key"])
    best = nearest(asked, pool, [*scope, "txn_key"], "tie", "row")
    return lookup(asked, best, [*scope, "txn_key", "day", "target"], "src_pos", "inner").select(
        *scope, "src_pos", F.col("row").alias("invoice_pick")
    )


def candidate_sets(
    pg: DataFrame, bank: DataFrame, invoice: DataFrame, scope: tuple[str, ...] = ()
) -> DataFrame:
    """One row per anchor: winners, candidate counts, tier, duplicate flag and rival count."""
    # the gate's totals first, while an anchor is a short row
    counted = lookup(pg, gate_totals(pg, bank, scope), [*scope, "expected_net", "day"], "src_pos")
    # keys are made again where they are read, not written beside the references they come from
    exact = with_keys(stage(exact_groups(counted, bank, invoice, scope).drop("utr_key", "txn_key"), "exact-groups"))
    open_case = F.col("exact_tier").isNull()
    special = open_case | F.col("pick_bank") | F.col("pick_invoice") | F.col("count_own")
    # one row: which of the rarer branches this batch needs at all
    need = exact.agg(
        F.max(open_case).alias("fuzzy"),
        F.max("pick_bank").alias("picks"),
        F.max("pick_invoice").alias("bills"),
        F.max("count_own").alias("own"),
    ).first()

    me = [*scope, "src_pos"]
    empty = {
        "f": "struct<n:bigint,row:%s,duplicate:boolean>" % exact.schema["u"].dataType["row"].dataType.simpleString(),
        "bank_pick": exact.schema["u"].dataType["row"].dataType.simpleString(),
        "invoice_pick": exact.schema["i"].dataType["row"].dataType.simpleString(),
        "own": "bigint",
    }
    hard = exact.filter(special)
    branches = (
        (need.fuzzy, "f", lambda: match_fuzzy(exact.filter(open_case), bank, scope)),
        (need.picks, "bank_pick", lambda: _bank_winners(exact.filter("pick_bank"), bank, scope)),
        (need.bills, "invoice_pick", lambda: _invoice_winners(exact.filter("pick_invoice"), invoice, scope)),
        (need.own, "own", lambda: own_in_gate(exact.filter("count_own"), bank, scope)),
    )
    for wanted, column, build in branches:
        hard = hard.join(build(), me, "left") if wanted else hard.withColumn(column, F.lit(None).cast(empty[column]))
    plain = exact.filter(~special)
    for column, kind in empty.items():
        plain = plain.withColumn(column, F.lit(None).cast(kind))
    everyone = plain.unionByName(hard)

    tier = F.coalesce("exact_tier", F.when(F.col("f").isNotNull(), "fuzzy"), F.lit("none"))

    def per_tier(field: str, default: Column) -> Column:
        chosen = (
            F.when(F.col("exact_tier") == "exact_utr", F.col(f"u.{field}"))
            .when(F.col("exact_tier") == "exact_txn", F.col(f"t.{field}"))
            .otherwise(F.col(f"f.{field}"))
        )
        return F.coalesce(chosen, default)

    own_rows = F.coalesce(
        "own",
        F.when(F.col("exact_tier").isNull(), F.coalesce("f.n", F.lit(0))).otherwise(_own_uniform()),
    )
    first_bank = (
        F.when(F.col("exact_tier") == "exact_utr", F.col("u.row"))
        .when(F.col("exact_tier") == "exact_txn", F.col("t.row"))
        .otherwise(F.col("f.row"))
    )
    in_gate_rows = F.coalesce("in_gate", F.lit(0))
    dropped = ("u", "t", "i", "f", "bank_pick", "invoice_pick", "own", "in_gate", "exact_tier",
               "pick_bank", "pick_invoice", "count_own", "utr_key", "txn_key")
    return everyone.select(
        *[c for c in everyone.columns if c not in dropped],
        F.coalesce("bank_pick", first_bank).alias("bank"),
        F.coalesce("invoice_pick", F.col("i.row")).alias("invoice"),
        tier.alias("bank_match_type"),
        F.when(F.col("i").isNotNull(), "exact_txn").otherwise("none").alias("invoice_match_type"),
        per_tier("n", F.lit(0)).cast("bigint").alias("bank_candidate_count"),
        F.coalesce("i.n", F.lit(0)).cast("bigint").alias("invoice_candidate_count"),
        in_gate_rows.cast("bigint").alias("gated_bank_rows"),
        (in_gate_rows - own_rows).cast("bigint").alias("bank_ambiguity_count"),
        # every invoice of the transaction is already a candidate
        F.lit(0).cast("bigint").alias("invoice_ambiguity_count"),
        (per_tier("duplicate", F.lit(False)) | F.coalesce("i.duplicate", F.lit(False))).alias("duplicate_detected"),
    )


# --- lookups from outside --------------------------------------------------------------------


def proposal_lookup(proposals: DataFrame, bank: DataFrame) -> DataFrame:
    """Whether a proposed transaction id exists among the bank rows, and how often."""
    index = (
        bank.filter(_present("txn_id"))
        .groupBy(F.col("txn_id").alias("proposed_txn_id"))
        .agg(F.count(F.lit(1)).alias("bank_rows"), F.sum("amount").alias("bank_amount"))
    )
    joined = lookup(proposals, index, ["proposed_txn_id"], "proposal_id")
    return joined.withColumn("found", F.col("bank_rows").isNotNull()).withColumn(
        "bank_rows", F.coalesce("bank_rows", F.lit(0))
    )
