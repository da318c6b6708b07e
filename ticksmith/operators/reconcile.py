"""Local state against a venue's: balances, orders, and recovery after a reconnect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.functions.scalars import TERMINAL
from ticksmith.operators.scans import SPLIT_ROWS, reflected, with_running


def reconcile_balances(local: DataFrame, remote: DataFrame, key: str = "key", amount: str = "amount") -> DataFrame:
    """All keys of both sides, whether they agree, and the merged amount, where the remote side wins."""
    a = local.select(key, F.col(amount).alias("local_amount"))
    b = remote.select(key, F.col(amount).alias("remote_amount"))
    return a.join(b, key, "full_outer").withColumns({"matched": F.col("local_amount").eqNullSafe(F.col("remote_amount")), "merged_amount": F.coalesce("remote_amount", "local_amount")})


_FIELDS = ["status", "filled_size", "fill_price", "fee"]


def _known(value: Column, order: Column) -> Column:
    """The last value by ``order`` that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def _status(name: str = "status") -> Column:
    """A venue's status; an empty one says nothing."""
    return F.nullif(F.upper(name), F.lit(""))


def latest_states(remote: DataFrame) -> DataFrame:
    """One row an order after all its updates by ``seq``: of each field the last value that isn't null."""
    order = F.struct("seq", *_FIELDS)
    return remote.groupBy("order_id").agg(*(_known(F.col(f), order).alias(f) for f in _FIELDS))


def reconcile_orders(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Each local order beside the remote view; a missing remote order is NOT_FOUND. Remote values replace local ones.

    With a column ``seq``, ``remote`` may have several updates of an order, else one row each.
    """
    remote = latest_states(remote) if "seq" in remote.columns else remote
    a = local.select("order_id", *(F.col(f).alias(f"local_{f}") for f in _FIELDS))
    b = remote.select("order_id", *(F.col(f).alias(f"remote_{f}") for f in _FIELDS), F.lit(True).alias("found"))
    out = a.join(b, "order_id", "left").withColumn("remote_status", F.when(F.col("found"), F.col("remote_status")).otherwise("NOT_FOUND")).drop("found")
    same = F.lit(True)
    for f in _FIELDS:
        same = same & F.col(f"local_{f}").eqNullSafe(F.col(f"remote_{f}"))
    merged = {f: F.coalesce(f"remote_{f}", f"local_{f}") for f in _FIELDS}
    out = out.withColumns({"matched": same} | merged)
    return out.withColumns({"pending": ~F.col("status").isin(TERMINAL), "message": F.when(F.col("matched"), "order state matched").otherwise("order state reconciled")})


def _updates(local: DataFrame, remote: DataFrame, more: list[str]) -> DataFrame:
    """Local states (side 0) and remote updates (side 1) of all orders, in one table; ``more`` where a side has them."""
    missing = lambda t, c: F.col(c) if c in t.columns else F.lit(None)
    seq = F.col("seq").cast("long") if "seq" in remote.columns else F.lit(None).cast("long")
    a = local.select("order_id", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("seq"), "side", F.col("size").cast("double"), missing(local, "price").cast("double").alias("price"), *(F.col(f).cast("string" if f == "status" else "double").alias(f) for f in _FIELDS), *(missing(local, c).alias(c) for c in more))
    kinds = {f.name: f.dataType for f in a.schema}
    b = remote.select("order_id", F.lit(1).alias("_side"), seq.alias("seq"), F.nullif("side", F.lit("")).alias("side") if "side" in remote.columns else F.lit(None).cast("string").alias("side"), missing(remote, "size").cast("double").alias("size"), missing(remote, "price").cast("double").alias("price"), _status().alias("status"), *(F.col(f).cast("double").alias(f) for f in _FIELDS[1:]), *(missing(remote, c).cast(kinds[c]).alias(c) for c in more))
    return a.unionByName(b)


_ORDER = ["seq", "_side", *_FIELDS]


def recover_orders(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local orders with those that only the venue knows, all brought to the last remote state.

    ``remote`` has any number of updates of an order, by ``seq``; a field that an update leaves out stays. An empty remote
    status leaves the local one, or SUBMITTED for an order that only the venue knows, whose missing fee is 0. One
    aggregation of both sides; nothing is joined.
    """
    order = F.struct("_side", *_ORDER)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    inserted = F.min("_side") == 1
    return (
        _updates(local, remote, [])
        .groupBy("order_id")
        .agg(
            F.coalesce(first("side"), F.lit("unknown")).alias("side"), F.coalesce(first("size"), F.lit(0.0)).alias("size"), F.coalesce(_known(F.col("status"), order), F.lit("SUBMITTED")).alias("status"),
            *(_known(F.col(f), order).alias(f) for f in _FIELDS[1:3]), F.coalesce(_known(F.col("fee"), order), F.when(inserted, 0.0)).alias("fee"), (F.max("_side") == 1).alias("recovered"), inserted.alias("inserted"),
        )
    )


_TAKEN = ["FILLED", "PARTIALLY_FILLED"]


def order_states(local: DataFrame, remote: DataFrame, by: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each remote update beside the order's state before it: the last values that the local order or updates gave.

    (by, order_id, seq, side, size, price, update's fields, before_<field>, first: whether it made the order known).
    ``by``, side, size and price are those of the local order, or of the first update of one that only the venue knows.
    """
    made = F.struct(*by, "side", "size", "price", "_side")
    before = {f"before_{f}": ("last_before", F.col(f)) for f in _FIELDS}
    rows = with_running(_updates(local, remote, by), ["order_id"], _ORDER, {"_made": ("first", made), "_known": ("last_before", F.col("_side"))} | before, split_rows)
    rows = rows.where("_side = 1").withColumn("first", F.col("_known").isNull())
    return rows.select("order_id", "seq", *(F.col(f"_made.{c}").alias(c) for c in [*by, "side", "size", "price"]), *_FIELDS, *before, "first")


def fill_deltas(local: DataFrame, remote: DataFrame, by: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """What remote updates add to orders: (by, order_id, seq, side, delta, price, fee_delta), where something is added.

    Updates of an order are taken one after another by ``seq``, each against the state that those before it left. An
    order that turns filled counts from its fills so far to the remote fills, or to its size if these are unknown; one
    that was filled before counts what the update has more. The update by which the venue makes an order known adds
    nothing, since the account snapshot has it; later ones do, if ``remote`` has the columns ``by`` too.
    """
    rows = order_states(local, remote, by, split_rows).where(F.col("status").isin(_TAKEN) & F.col("side").isin("buy", "sell") & ~F.col("first"))
    zero = F.lit(0.0)
    assumed = F.when(F.col("before_status").isin(_TAKEN), 0.0).otherwise(F.col("size"))
    rows = rows.withColumns(
        {
            "delta": F.coalesce("filled_size", assumed) - F.coalesce("before_filled_size", zero),
            "paid": F.coalesce(F.nullif("fill_price", zero), "price", zero),
            "fee_delta": F.greatest(zero, F.coalesce("fee", zero) - F.coalesce("before_fee", zero)),
        }
    )
    return rows.where("delta > 0").select(*by, "order_id", "seq", "side", "delta", F.col("paid").alias("price"), "fee_delta")


def apply_fills(deltas: DataFrame, start: DataFrame, by: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(by, balance, position) of every account in ``start`` (by, balance, position) after its fills in order of seq.

    Sells floor the position at 0, so it is a reflected sum: with s the start and all signed fills up to a row, the
    position there is ``s - min(0, min s)``. Balances are plain sums. A hot account is scanned in chunks.
    """
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    rows = with_running(deltas, by, ["seq", "order_id"], {"_s": ("sum", sign * F.col("delta"))}, split_rows)
    flow = F.sum(-sign * F.col("delta") * F.col("price") - F.col("fee_delta"))
    done = rows.groupBy(*by).agg(flow.alias("flow"), F.max_by("_s", F.struct("seq", "order_id")).alias("s"), F.min("_s").alias("low"))
    out = start.join(done, by, "left")
    held = F.coalesce("position", F.lit(0.0))
    return out.select(*by, (F.coalesce("balance", F.lit(0.0)) + F.coalesce("flow", F.lit(0.0))).alias("balance"), F.coalesce(reflected(F.col("s"), F.col("low"), held), held).alias("position"))


def recover_accounts(local: DataFrame, remote: DataFrame, start: DataFrame, snapshot: DataFrame, by: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Accounts after a reconnect, in one call: remote updates are applied, then the venue's snapshot replaces what it has.

    ``start`` and ``snapshot``: (by, balance, position), one row an account. Gives (by, local and remote values, whether
    they agree, and the merged balance and position). Accounts that one side lacks are kept; a null in the snapshot says
    nothing.
    """
    here = apply_fills(fill_deltas(local, remote, by, split_rows), start, by, split_rows).select(*by, F.col("balance").alias("local_balance"), F.col("position").alias("local_position"))
    there = snapshot.select(*by, F.col("balance").alias("remote_balance"), F.col("position").alias("remote_position"))
    out = here.join(there, by, "full_outer")
    same = F.lit(True)
    for c in ("balance", "position"):
        same = same & (F.col(f"local_{c}").eqNullSafe(F.col(f"remote_{c}")))
    return out.withColumns({"matched": same, "balance": F.coalesce("remote_balance", "local_balance"), "position": F.coalesce("remote_position", "local_position")})


def open_orders(orders: DataFrame) -> DataFrame:
    """Orders that can still change, as a kill switch would cancel them."""
    return orders.where(~F.col("status").isin(TERMINAL))


def kill_switch(orders: DataFrame, tripped: Column) -> DataFrame:
    """Orders after a kill switch: where ``tripped`` all that can still change are CANCELED, and ``stopped`` tells which."""
    stopped = tripped & ~F.coalesce(F.col("status"), F.lit("")).isin(TERMINAL)
    return orders.withColumns({"stopped": F.coalesce(stopped, F.lit(False)), "status": F.when(stopped, "CANCELED").otherwise(F.col("status"))})


def account_summary(balances: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: orders unsettled and matched, mismatches, and whether all agrees."""
    o = orders.agg(F.count("*").alias("orders"), F.count_if("pending").alias("pending_orders"), F.count_if("matched").alias("matched_orders"), F.count_if(~F.col("matched")).alias("mismatched_orders"))
    b = balances.agg(F.count_if(~F.col("matched")).alias("mismatched_balances"))
    # one row by one row
    return o.join(b, F.lit(True)).withColumn("status", F.when((F.col("mismatched_orders") == 0) & (F.col("mismatched_balances") == 0), "matched").otherwise("mismatched"))


def mismatches(balances: DataFrame, orders: DataFrame) -> DataFrame:
    """Each balance and order that differs: (kind, key, local, remote), as a report lists them."""
    b = balances.where(~F.col("matched")).select(F.lit("balance").alias("kind"), F.col("key").cast("string").alias("key"), F.col("local_amount").cast("string").alias("local"), F.col("remote_amount").cast("string").alias("remote"))
    o = orders.where(~F.col("matched")).select(F.lit("order").alias("kind"), F.col("order_id").cast("string").alias("key"), F.col("local_status").alias("local"), F.col("remote_status").alias("remote"))
    return b.unionByName(o)
