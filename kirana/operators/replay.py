"""Ordered change logs whose decisions depend on earlier decisions (SNK4, SNK7, U3).

Whether a change is accepted depends on the state that the accepted changes before it
left: a name may be added again after a delete, a caller registered twice is updated.
The replay assumes a decision for every change, works out the state before each change
by two-level scans over those assumptions, decides anew, and repeats until nothing
changes.  A change is decided right as soon as all changes before it are, so every round
settles at least the first change still wrong, and a result that repeats itself is the
sequential one.  The rounds are as many as the longest chain of changes that overturn one
another, a handful in practice; there is no other bound on them.

No key is one task's: scans split a key's changes into runs of ``RUN`` places in the log.
Decisions are written to the shared folder each round.  Joins ask for a merge: a table a
little too small for a shuffle would pass through the driver, in every round again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kirana.functions.phone import normalize_phone, py_strip
from kirana.operators.scan import running, running_floor_balance
from kirana.session import remove, written

#: Places of the log in one run of a scan.
RUN = 4096


def numbered(changes: DataFrame, order: Sequence[str]) -> DataFrame:
    """The log with ``_at``, which rises with ``order``; rows equal in it keep one order from here on."""
    log = changes.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(log, "replay-log")[0]


def fresh_numbers(log: DataFrame, wants: Column, first: int) -> DataFrame:
    """``_fresh`` for the rows that want a number: ``first``, ``first`` + 1 and so on along the log."""
    # _at holds the number of the sorted partition above its lowest 33 bits
    some = log.filter(wants).select("_at", F.shiftright("_at", 33).alias("_part"))
    before = (some.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    given = some.select("_at", "_part", nth.alias("_nth")).join(before, "_part").select("_at", (F.col("_before") + F.col("_nth") + (first - 1)).alias("_fresh"))
    return log.join(given.hint("merge"), "_at", "left")


def settled(start: DataFrame, decide: Callable[[DataFrame], tuple[DataFrame, str]]) -> DataFrame:
    """The decisions that ``decide`` confirms.

    ``decide`` takes ``_at`` and ``decision`` and returns them anew, with the decision it
    was given as ``_was`` (further columns are kept from the last round), and the path of
    what it has written on the way."""
    spark = start.sparkSession
    now, path = written(start, "replay-decisions")
    while True:
        before = path
        new, scratch = decide(now)
        now, path = written(new, "replay-decisions")
        remove(spark, before)
        remove(spark, scratch)
        if not now.filter(~F.col("decision").eqNullSafe(F.col("_was"))).limit(1).count():
            return now.drop("_was")


def _run() -> Column:
    return F.floor(F.col("_at") / RUN)


# ---------------------------------------------------------------------------
# SNK7: catalog changes
# ---------------------------------------------------------------------------

def _catalog_log(products: DataFrame, changes: DataFrame, order: Sequence[str], used: DataFrame | None, new_ids: bool) -> DataFrame:
    log = changes
    for c, kind in (("pid", "bigint"), ("name", "string"), ("category", "string"), ("price", "double"), ("unit", "string"), ("stock_quantity", "bigint")):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast(kind))
    log = numbered(log, order)
    top = products.agg(F.max("id")).first()[0] or 0
    log = fresh_numbers(log, F.col("op") == "add", top + 1)
    text = {c: F.coalesce(py_strip(F.col(c)), F.lit("")) for c in ("name", "category", "unit")}
    log = log.select(
        "_at", "op", F.when(F.col("op") == "add", F.col("_fresh")).when(F.lit(new_ids) | (F.col("pid") <= top), F.col("pid")).alias("id"), text["name"].alias("name"),
        F.when(text["category"] == "", F.lit("Groceries")).otherwise(text["category"]).alias("category"), "price",
        F.when(text["unit"] == "", F.lit("1 packet")).otherwise(text["unit"]).alias("unit"),
        F.when(F.col("op") == "add", F.coalesce("stock_quantity", F.lit(50))).otherwise(F.col("stock_quantity")).alias("stock_quantity"),
        *[F.col(c).alias(f"_given_{c}") for c in changes.columns])
    writes = F.col("op").isin("add", "update")
    log = log.withColumn("fault", F.when(~F.coalesce(F.col("op").isin("add", "update", "delete"), F.lit(False)), F.lit("unknown op"))
                         .when(writes & (F.col("name") == ""), F.lit("empty name"))
                         .when(writes & F.coalesce(F.col("price") < 0, F.lit(False)), F.lit("negative price")))
    held = F.lit(False)
    if used is not None:
        ids = used.select(F.col("product_id").alias("_used")).filter("_used is not null").distinct()
        log = log.join(ids.hint("merge"), F.col("id") == F.col("_used"), "left")
        held = F.col("_used").isNotNull()
    return written(log.withColumn("held", held), "replay-catalog")[0]


def replay_product_changes(products: DataFrame, changes: DataFrame, order: Sequence[str], used: DataFrame | None = None,
                           unique_names: bool = True, new_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """SNK7: the changes one after the other; the verdict on each, and the catalog after them.

    ``changes``: op, pid, name, category, price, unit, stock_quantity and the columns of
    ``order`` (absent ones count as null).  ``add`` is rejected while a product has the
    name in any letter case; ``update`` writes the whole row of a product and is rejected
    where it renames it to the name of another (left out with ``unique_names`` false, for
    catalogs whose names repeat); ``delete`` is rejected for products of ``used``
    (product_id), which orders refer to.  Empty names, negative prices, unknown ids and
    unknown ops are rejected; an empty category or unit and a null stock of an add take
    the defaults.  The k-th add has the id max(id) + k, so later changes can name it (with
    ``new_ids`` false they cannot).

    Verdicts have the columns of ``changes`` and ``id``, ``accepted`` and ``reason``.
    """
    log = _catalog_log(products, changes, order, used, new_ids)
    base = products.select(F.col("id").alias("_base"), F.col("name").alias("_base_name"))
    holders = products.groupBy(F.col("name").alias("_n")).agg(F.count(F.lit(1)).alias("_held"))
    folded = products.groupBy(F.lower("name").alias("_k")).agg(F.count(F.lit(1)).alias("_held"))

    def decide(now: DataFrame) -> tuple[DataFrame, str]:
        done = F.coalesce(F.col("decision"), F.lit(False))
        e = log.join(now.select("_at", "decision").hint("merge"), "_at")
        e = running(e.withColumn("_done", done), ["id"], _run(), [F.col("_at")],
                    {"_dead": ("max", F.when(F.col("_done") & (F.col("op") == "delete"), 1)),
                     "_born": ("max", F.when(F.col("_done") & (F.col("op") == "add"), 1)),
                     "_named": ("last", F.when(F.col("_done") & F.col("op").isin("add", "update"), F.col("name")))}, inclusive=False)
        e = e.join(base.hint("merge"), F.col("id") == F.col("_base"), "left")
        lives = F.col("_dead").isNull() & (F.col("_base").isNotNull() | F.col("_born").isNotNull())
        e = e.withColumn("lives", lives).withColumn("was_named", F.coalesce("_named", "_base_name"))
        e, path = written(e.drop("_dead", "_born", "_named", "_base", "_base_name"), "replay-products")
        renames = (F.col("op") == "update") & F.col("lives") & F.col("fault").isNull() & (F.col("name") != F.col("was_named"))
        leaves = F.col("_done") & ((F.col("op") == "delete") | renames) & F.col("was_named").isNotNull()
        # names that come and go, under the exact name and under the folded one
        gone = e.filter(leaves).select("_at", F.col("was_named").alias("_n"), F.lit(-1).alias("_d"), F.lit(False).alias("asks"))
        came = e.filter(renames).select("_at", F.col("name").alias("_n"), F.col("_done").cast("int").alias("_d"), F.lit(True).alias("asks"))
        adds = e.filter((F.col("op") == "add") & F.col("fault").isNull()).select("_at", F.col("name").alias("_n"), F.col("_done").cast("int").alias("_d"))
        taken = None
        if unique_names:
            m = gone.unionByName(came).unionByName(adds.withColumn("asks", F.lit(False)))
            m = running(m, ["_n"], _run(), [F.col("_at"), F.col("_d")], {"_before": ("sum", F.col("_d"))}, inclusive=False)
            taken = (m.filter("asks").join(holders.hint("merge"), "_n", "left")
                     .select("_at", (F.coalesce("_held", F.lit(0)) + F.col("_before")).alias("others")))
        # an add lifts the count of its folded name to 1 at least; it is accepted from 0
        moves = (gone.unionByName(came).filter("_d != 0").select("_at", F.lower("_n").alias("_k"), F.lit(2).alias("_part"), "_d")
                 .unionByName(adds.select("_at", F.lower("_n").alias("_k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_part"), F.lit(0).alias("_d"))))
        moves = moves.join(folded.hint("merge"), "_k", "left").withColumn("_open", F.coalesce("_held", F.lit(0)) - 1)
        moves = running_floor_balance(moves, ["_k"], _run(), [F.col("_at"), F.col("_part")], F.col("_open"), F.col("_d"), "_b", F.col("_part") == 1)
        free = moves.filter("_part = 0").select("_at", (F.col("_b") < 0).alias("free"))
        e = e.join(free.hint("merge"), "_at", "left")
        e = e.join(taken.hint("merge"), "_at", "left") if taken is not None else e.withColumn("others", F.lit(0))
        reason = (F.when(F.col("fault").isNotNull(), F.col("fault"))
                  .when((F.col("op") == "add") & ~F.col("free"), F.lit("already exists"))
                  .when((F.col("op") != "add") & ~F.col("lives"), F.lit("not found"))
                  .when((F.col("op") == "delete") & F.col("held"), F.lit("used by an order"))
                  .when((F.col("op") == "update") & (F.coalesce("others", F.lit(0)) > 0), F.lit("name taken")))
        return e.select("_at", reason.isNull().alias("decision"), F.coalesce(reason, F.lit("ok")).alias("reason"), F.col("decision").alias("_was")), path

    verdicts = log.join(settled(log.select("_at", F.col("fault").isNull().alias("decision")), decide).hint("merge"), "_at")
    cols = [c for c in ("name", "category", "price", "unit", "stock_quantity") if c in products.columns]
    last = (verdicts.filter("decision").groupBy("id")
            .agg(F.max((F.col("op") == "delete")).alias("_dead"), F.max_by(F.struct(*cols), F.when(F.col("op") != "delete", F.col("_at"))).alias("_row")))
    table = products.select("id", F.struct(*cols).alias("_had")).join(last.hint("merge"), "id", "full_outer").filter("_dead is null or not _dead")
    table = table.select("id", F.coalesce("_row", "_had").alias("r")).select("id", "r.*")
    given = [F.col(f"_given_{c}").alias(c) for c in changes.columns]
    return verdicts.select(*given, F.when(F.col("op") == "add", F.when(F.col("decision"), F.col("id"))).otherwise(F.col("id")).alias("id"),
                           F.col("decision").alias("accepted"), "reason"), table


# ---------------------------------------------------------------------------
# SNK4: customer changes
# ---------------------------------------------------------------------------

def _customer_log(customers: DataFrame, changes: DataFrame, order: Sequence[str]) -> DataFrame:
    log = changes
    for c, kind in (("cid", "bigint"), ("phone", "string"), ("name", "string"), ("address", "string")):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast(kind))
    log = numbered(log, order)
    top = customers.agg(F.max("id")).first()[0] or 0
    log = fresh_numbers(log, F.col("op") == "register", 0)
    text = {c: F.coalesce(py_strip(F.col(c)), F.lit("")) for c in ("phone", "name", "address")}
    log = log.select("_at", "op", F.col("cid").alias("id"), (top + 1 + 2 * F.col("_fresh")).alias("fresh"), text["phone"].alias("raw"), text["name"].alias("name"),
                     text["address"].alias("address"), *[F.col(c).alias(f"_given_{c}") for c in changes.columns])
    log = log.withColumn("norm", normalize_phone(F.col("raw")))
    log = log.withColumn("canon", F.when(F.length("norm") == 10, F.concat(F.lit("+91"), "norm")).otherwise(F.col("raw")))
    log = log.withColumn("alias", F.when((F.col("norm") != "") & (F.col("norm") != F.col("canon")), F.col("norm")))
    named, by_phone = F.col("op").isin("register", "update"), F.col("op").isin("register", "update", "address", "lookup")
    fault = (F.when(~F.coalesce(F.col("op").isin("register", "update", "address", "delete", "lookup"), F.lit(False)), F.lit("unknown op"))
             .when(named & (F.col("name") == ""), F.lit("empty name"))
             .when((F.col("op") == "register") & (F.col("address") == ""), F.lit("empty address"))
             .when(by_phone & (F.col("raw") == ""), F.lit("empty phone")))
    return written(log.withColumn("fault", fault), "replay-callers")[0]


def replay_customer_changes(customers: DataFrame, changes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """SNK4: the changes one after the other; the verdict on each, and the customers after them.

    ``changes``: op, cid, phone, name, address and the columns of ``order`` (absent ones
    count as null).  ``register`` looks the phone up by its candidates (J1) among the rows
    that are there then; the row found gets name and address, else the canonical phone and
    its 10-digit alias are inserted.  ``address`` writes the address of the row found.
    ``update`` writes the row ``cid`` whole, its phone in canonical form, and is rejected
    where another row has that phone; ``delete`` removes the row ``cid``; ``lookup`` only finds
    the row of a phone, and its verdict has the ``name`` and ``address`` of then.  Phones are unique
    (of repeated ones the smallest id answers).  The k-th registration inserts the ids
    max(id) + 2k - 1 and, for the alias, max(id) + 2k.

    Verdicts have the columns of ``changes`` and ``id`` (the row written), ``accepted`` and
    ``reason``; customers have id, phone_number, name and address.
    """
    log = _customer_log(customers, changes, order)
    base = customers.select(F.col("id").alias("_base"), F.col("phone_number").alias("_base_phone"))
    answers = customers.groupBy(F.col("phone_number").alias("phone")).agg(F.min("id").alias("_first"))
    ok = F.col("fault").isNull()
    by_lookup = F.col("op").isin("register", "address", "lookup")

    def decide(now: DataFrame) -> tuple[DataFrame, str]:
        e = log.join(now.select("_at", "decision").hint("merge"), "_at")
        made = e.filter((F.col("op") == "register") & (F.col("decision") == F.col("fresh")))
        made = made.select("_at", F.explode(F.array(F.struct(F.col("fresh").alias("id"), F.col("canon").alias("phone")),
                                                    F.struct((F.col("fresh") + 1).alias("id"), F.col("alias").alias("phone")))).alias("m")).select("_at", "m.*").filter("phone is not null")
        asked = e.filter(F.col("op").isin("update", "delete")).select("_at", "id", F.col("canon").alias("phone"), F.col("op").alias("kind"), F.col("decision").isNotNull().alias("done"))
        rows = asked.unionByName(made.select("_at", "id", "phone", F.lit("create").alias("kind"), F.lit(True).alias("done")))
        rows = running(rows, ["id"], _run(), [F.col("_at")],
                       {"_dead": ("max", F.when(F.col("done") & (F.col("kind") == "delete"), 1)), "_born": ("max", F.when(F.col("kind") == "create", 1)),
                        "_phone": ("last", F.when(F.col("done") & (F.col("kind") != "delete"), F.col("phone")))}, inclusive=False)
        rows = rows.filter("kind != 'create'").join(base.hint("merge"), F.col("id") == F.col("_base"), "left")
        lives = F.col("_dead").isNull() & (F.col("_base").isNotNull() | F.col("_born").isNotNull())
        rows = rows.select("_at", "id", "phone", "kind", "done", lives.alias("lives"), F.coalesce("_phone", "_base_phone").alias("had"))
        rows, path = written(rows, "replay-rows")
        moved = rows.filter(F.col("done") & F.col("had").isNotNull() & ((F.col("kind") == "delete") | (F.col("had") != F.col("phone"))))
        # who holds a phone: nobody after it is given up
        events = (made.select("_at", "phone", F.col("id").alias("who")).unionByName(moved.select("_at", F.col("had").alias("phone"), F.lit(None).cast("bigint").alias("who")))
                  .unionByName(moved.filter("kind = 'update'").select("_at", "phone", F.col("id").alias("who"))))
        events = events.select("_at", "phone", F.lit(1).alias("part"), F.struct("who").alias("holder"))
        n = F.col("norm")
        tries = F.array_distinct(F.array(F.col("raw"), n, F.when(n != "", F.concat(F.lit("+91"), n)).otherwise(F.col("raw")),
                                         F.when(n != "", F.concat(F.lit("0"), n)).otherwise(F.col("raw"))))
        probes = (e.filter(ok & F.col("op").isin("register", "address", "lookup", "update"))
                  .select("_at", F.posexplode(F.when(F.col("op") == "update", F.array("canon")).otherwise(tries)).alias("pos", "phone")))
        seen = (probes.select("_at", "phone", "pos", F.lit(0).alias("part"), F.lit(None).cast("struct<who:bigint>").alias("holder"))
                .unionByName(events.withColumn("pos", F.lit(None).cast("int"))))
        seen = running(seen, ["phone"], _run(), [F.col("_at"), F.col("part")], {"_now": ("last", F.col("holder"))}, inclusive=False)
        seen = seen.filter("part = 0").join(answers.hint("merge"), "phone", "left").withColumn("who", F.when(F.col("_now").isNotNull(), F.col("_now.who")).otherwise(F.col("_first"))).filter("who is not null")
        found = seen.groupBy("_at").agg(F.min_by("who", "pos").alias("found"))
        e = e.join(found.hint("merge"), "_at", "left").join(rows.select("_at", "lives").hint("merge"), "_at", "left")
        reason = (F.when(~ok, F.col("fault"))
                  .when(F.col("op").isin("update", "delete") & ~F.col("lives"), F.lit("not found"))
                  .when((F.col("op") == "update") & (F.col("found") != F.col("id")), F.lit("phone taken"))
                  .when(F.col("op").isin("address", "lookup") & F.col("found").isNull(), F.lit("not found")))
        target = F.when(F.col("op") == "register", F.coalesce("found", "fresh")).when(by_lookup, F.col("found")).otherwise(F.col("id"))
        return e.select("_at", F.when(reason.isNull(), target).alias("decision"), F.coalesce(reason, F.lit("ok")).alias("reason"), F.col("decision").alias("_was")), path

    start = log.select("_at", F.when(ok & ~F.coalesce(by_lookup, F.lit(False)), F.col("id")).alias("decision"))
    verdicts = log.join(settled(start, decide).hint("merge"), "_at")
    inserts = F.coalesce((F.col("op") == "register") & (F.col("decision") == F.col("fresh")), F.lit(False))
    done = verdicts.filter("decision is not null and op != 'lookup'")
    whole = F.col("op").isin("register", "update")
    written_rows = done.select("_at", F.col("decision").alias("id"), (F.col("op") == "delete").alias("gone"), F.when(whole, F.col("name")).alias("name"),
                               F.when(F.col("op") != "delete", F.col("address")).alias("address"),
                               F.when(inserts | (F.col("op") == "update"), F.col("canon")).alias("phone"))
    aliases = done.filter(inserts & F.col("alias").isNotNull()).select("_at", (F.col("fresh") + 1).alias("id"), F.lit(False).alias("gone"), "name", "address", F.col("alias").alias("phone"))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_{c}")

    writes = written_rows.unionByName(aliases)
    now = writes.groupBy("id").agg(F.max("gone").alias("_gone"), last("phone"), last("name"), last("address"))
    table = customers.select("id", "phone_number", "name", "address").join(now.hint("merge"), "id", "full_outer").filter("_gone is null or not _gone")
    table = table.select("id", F.coalesce("_phone", "phone_number").alias("phone_number"), F.coalesce("_name", "name").alias("name"), F.coalesce("_address", "address").alias("address"))
    # name and address that a lookup finds
    asks = verdicts.filter("op = 'lookup' and decision is not null").select("_at", F.col("decision").alias("id"), F.lit(True).alias("asks"))
    then = writes.select("_at", "id", "name", "address", F.lit(False).alias("asks")).unionByName(asks, allowMissingColumns=True)
    then = running(then, ["id"], _run(), [F.col("_at")], {"_n": ("last", F.col("name")), "_a": ("last", F.col("address"))}, inclusive=False)
    then = (then.filter("asks").join(customers.select(F.col("id").alias("_base"), F.col("name").alias("_bn"), F.col("address").alias("_ba")).hint("merge"), F.col("id") == F.col("_base"), "left")
            .select("_at", F.coalesce("_n", "_bn").alias("_name"), F.coalesce("_a", "_ba").alias("_address")))
    given = [F.when(F.col("op") == "lookup", F.col(f"_{c}")).otherwise(F.col(f"_given_{c}")).alias(c) if c in ("name", "address") else F.col(f"_given_{c}").alias(c)
             for c in changes.columns]
    return verdicts.join(then.hint("merge"), "_at", "left").select(*given, F.col("decision").alias("id"), F.col("decision").isNotNull().alias("accepted"), "reason"), table


# ---------------------------------------------------------------------------
# O1, O2, O3, FIL5 and A5 in one order of time
# ---------------------------------------------------------------------------

#: The statuses that an order may be given.
STATUSES = ("CONFIRMED", "PREPARING", "OUT_FOR_DELIVERY", "DELIVERED", "CANCELLED")


def replay_orders(requests: DataFrame, lines: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
                  order: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, cancellations and status changes on one stock, one after the other: stock falls and rises.

    ``requests``: request_id, op, order_id, status and the columns of ``order``.  ``lines``:
    request_id, pos, product_id (null where none was found), quantity.  ``orders``: order_id,
    status; ``items``: order_id, product_id, quantity; ``products``: id, stock_quantity.

    * ``place``: accepted as a CONFIRMED order iff it has lines, each for a known product whose
      stock when the order starts is at least the line's quantity (as O1); else the first line
      that fails gives the outcome ("not found", "insufficient stock"), and nothing is taken.
    * ``cancel`` (O2): an order that exists and isn't cancelled is, and its units come back.
    * ``status`` (O3): a valid status other than the present one is set; to CANCELLED brings
      units back, from CANCELLED takes them again, down to a stock of 0 at least.
    * ``track`` gives the status, ``check`` (one line) whether the stock suffices.

    Returns the requests with ``before`` (the order's status then), ``outcome`` and
    ``fails_at`` (pos), the lines with ``available`` (stock then), and the stock afterwards.
    """
    log = requests if "status" in requests.columns else requests.withColumn("status", F.lit(None).cast("string"))
    log = numbered(log.withColumn("_own", F.upper(py_strip(F.coalesce(F.col("order_id"), F.lit(""))))).withColumn("_new", F.upper(py_strip(F.col("status")))), order)
    known = orders.select(F.col("order_id").alias("_own"), F.col("status").alias("_had"))
    stock = products.select(F.col("id").alias("product_id"), F.col("stock_quantity").alias("opening"))
    wants, _ = written(lines.join(log.select("request_id", "_at", "op", "_own").hint("merge"), "request_id").join(stock.hint("merge"), "product_id", "left"), "replay-lines")
    asked = log.filter(F.col("op").isin("cancel", "status")).select("_own").distinct()
    base_units = (items.withColumn("_own", F.col("order_id")).join(asked.hint("merge"), "_own", "left_semi").groupBy("_own", "product_id").agg(F.sum("quantity").alias("units")))
    base_units, _ = written(base_units, "replay-units")

    def by_order(now: DataFrame) -> DataFrame:
        """The log with each order's status before the request, and the outcomes that follow from it."""
        e = log.join(now.select("_at", "decision").hint("merge"), "_at")
        sets = (F.when(F.col("decision") == "accepted", F.lit("CONFIRMED")).when(F.col("decision") == "cancelled", F.lit("CANCELLED"))
                .when((F.col("op") == "status") & (F.col("decision") == "changed"), F.col("_new")))
        e = running(e, ["_own"], _run(), [F.col("_at")], {"_set": ("last", sets)}, inclusive=False)
        e = e.join(known.hint("merge"), "_own", "left").withColumn("before", F.coalesce("_set", "_had")).drop("_set", "_had")
        none = F.col("before").isNull()
        outcome = (F.when(F.col("op") == "cancel", F.when(none, F.lit("not found")).when(F.col("before") == "CANCELLED", F.lit("already cancelled")).otherwise(F.lit("cancelled")))
                   .when(F.col("op") == "status", F.when(~F.coalesce(F.col("_new").isin(*STATUSES), F.lit(False)), F.lit("rejected")).when(none, F.lit("not found"))
                         .when(F.col("before") == F.col("_new"), F.lit("noop")).otherwise(F.lit("changed")))
                   .when(F.col("op") == "track", F.when(none, F.lit("not found")).otherwise(F.lit("found")))
                   .when((F.col("op") == "place") & ~none, F.lit("order exists"))
                   .when(~F.coalesce(F.col("op").isin("place", "check"), F.lit(False)), F.lit("unknown op")))
        return e.withColumn("outcome", outcome)

    def by_product(e: DataFrame) -> DataFrame:
        """Lines and moves with the stock after them (for lines: the stock then)."""
        took = wants.filter("op = 'place'").join(e.filter("op = 'place' and decision = 'accepted'").select("_at").hint("merge"), "_at", "left_semi")
        took = took.groupBy("_at", "_own", "product_id").agg(F.sum("quantity").alias("units"))
        sign = (F.when(F.col("outcome") == "cancelled", 1).when((F.col("op") == "status") & (F.col("outcome") == "changed"),
                F.when(F.col("_new") == "CANCELLED", 1).when(F.col("before") == "CANCELLED", -1)))
        turns = e.select("_at", "_own", sign.alias("sign")).filter("sign is not null")
        units = base_units.unionByName(took.select("_own", "product_id", "units"))
        moves = (turns.join(units.hint("merge"), "_own").select("_at", "product_id", (F.col("sign") * F.col("units")).alias("delta"), (F.col("sign") < 0).alias("floors"))
                 .unionByName(took.select("_at", "product_id", (-F.col("units")).alias("delta"), F.lit(False).alias("floors"))))
        moves = moves.join(stock.hint("merge"), "product_id").select("_at", "product_id", "opening", "delta", "floors", F.lit(1).alias("part"))
        probes = wants.filter("opening is not null").select("_at", "product_id", "opening", "pos", "quantity", "request_id", F.lit(0).cast("bigint").alias("delta"),
                                                            F.lit(False).alias("floors"), F.lit(0).alias("part"))
        rows = probes.unionByName(moves, allowMissingColumns=True)
        return running_floor_balance(rows, ["product_id"], _run(), [F.col("_at"), F.col("part")], F.col("opening"), F.col("delta"), "stock", F.col("floors"))

    def decide(now: DataFrame) -> tuple[DataFrame, str]:
        e, path = written(by_order(now), "replay-requests")
        seen = by_product(e).filter("part = 0").select("_at", "pos", F.col("stock").alias("available"))
        fits = wants.select("_at", "pos", "quantity", "opening").join(seen.hint("merge"), ["_at", "pos"], "left")
        fault = F.when(F.col("opening").isNull(), F.lit("not found")).when(F.col("available") < F.col("quantity"), F.lit("insufficient stock"))
        worst = fits.groupBy("_at").agg(F.min(F.when(fault.isNotNull(), F.struct("pos", fault.alias("fault")))).alias("_w"), F.count(F.lit(1)).alias("_lines"))
        e = e.join(worst.hint("merge"), "_at", "left")
        line_outcome = F.when(F.col("_lines").isNull(), F.lit("no items")).otherwise(F.coalesce("_w.fault", F.when(F.col("op") == "place", F.lit("accepted")).otherwise(F.lit("in stock"))))
        e = e.withColumn("outcome", F.coalesce("outcome", line_outcome))
        return e.select("_at", F.col("outcome").alias("decision"), "before", F.when(F.col("outcome") == F.col("_w.fault"), F.col("_w.pos")).alias("fails_at"),
                        F.col("decision").alias("_was")), path

    start = log.select("_at", F.when(F.col("op") == "place", F.lit("accepted")).alias("decision"))
    final = settled(start, decide)
    verdicts = log.join(final.hint("merge"), "_at").select(*requests.columns, "before", F.col("decision").alias("outcome"), "fails_at")
    moved, _ = written(by_product(by_order(final)), "replay-stock")
    seen = moved.filter("part = 0").select("request_id", "pos", F.col("stock").alias("available"))
    closing = moved.groupBy("product_id").agg(F.max_by("stock", F.struct("_at", "part")).alias("_s"))
    after = products.join(closing.hint("merge"), products["id"] == closing["product_id"], "left").select("id", F.coalesce("_s", "stock_quantity").alias("stock_quantity"))
    return verdicts, lines.join(seen.hint("merge"), ["request_id", "pos"], "left"), after
