"""Incremental cube refresh, last-wins lookups and the cube preparation job."""

import pyarrow.parquet as pq

from freightcube.operators.cube import CUBE_KEYS
from freightcube.plans.jobs import cube_prep
from freightcube.sources import star
from freightcube.sources.dims import lookup
from freightcube.sources.tables import load_tables
from freightcube.streaming.cube_refresh import compact, current_cube, start_cube_refresh

from conftest import SF_SMALL


def rows(df):
    return sorted(tuple(r[c] for c in CUBE_KEYS + ["tons"]) for r in df.collect())


def test_stream_folds_new_files_into_the_cube(spark, tmp_path):
    base, state = tmp_path / "data", tmp_path / "state"
    base.mkdir()
    for name in ("orders", "customer", "nation", "supplier", "part"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{name}.parquet"), base / f"{name}.parquet")
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    half = li.num_rows // 2
    pq.write_table(li.slice(0, half), base / "lineitem.parquet")

    q = start_cube_refresh(spark, str(base), str(state))
    q.awaitTermination()
    first = current_cube(spark, str(base), str(state))
    assert first.count() > 0

    assert compact(spark, str(state)) == 0                             # snapshot of epoch 0
    assert rows(current_cube(spark, str(base), str(state))) == rows(first)
    pq.write_table(li.slice(half), base / "lineitem-2.parquet")      # a new file arrives
    q = start_cube_refresh(spark, str(base), str(state))
    q.awaitTermination()
    assert rows(current_cube(spark, str(base), str(state))) == rows(star.od_cube(load_tables(spark, SF_SMALL)))

    q = start_cube_refresh(spark, str(base), str(state))               # nothing new: unchanged
    q.awaitTermination()
    assert rows(current_cube(spark, str(base), str(state))) == rows(star.od_cube(load_tables(spark, SF_SMALL)))
    assert compact(spark, str(state)) == 1                             # snapshot + epoch 1
    assert rows(current_cube(spark, str(base), str(state))) == rows(star.od_cube(load_tables(spark, SF_SMALL)))


def test_stream_keeps_shipments_of_late_orders(spark, tmp_path):
    """Half of the orders come after the shipments, in a folder of part files; no shipment is lost."""
    base, state = tmp_path / "data", tmp_path / "state"
    base.mkdir()
    for name in ("customer", "nation", "supplier", "part"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{name}.parquet"), base / f"{name}.parquet")
    orders, li = (pq.read_table(f"{SF_SMALL}/{n}.parquet") for n in ("orders", "lineitem"))
    for name, table in (("orders", orders.slice(0, orders.num_rows // 2)), ("lineitem", li.slice(0, li.num_rows // 2))):
        (base / f"{name}.parquet").mkdir()
        pq.write_table(table, base / f"{name}.parquet" / "part-0.parquet")
    start_cube_refresh(spark, str(base), str(state)).awaitTermination()
    early = rows(current_cube(spark, str(base), str(state)))
    pq.write_table(orders.slice(orders.num_rows // 2), base / "orders.parquet" / "part-1.parquet")
    assert len(rows(current_cube(spark, str(base), str(state)))) > len(early)   # a read already places them
    pq.write_table(li.slice(li.num_rows // 2), base / "lineitem.parquet" / "part-1.parquet")
    start_cube_refresh(spark, str(base), str(state)).awaitTermination()
    (state / "deltas" / "epoch=9").mkdir()                                      # an epoch that is being written
    pq.write_table(pq.read_table(f"{SF_SMALL}/nation.parquet"), state / "deltas" / "epoch=9" / "part-0.parquet")
    want = rows(star.od_cube(load_tables(spark, SF_SMALL)))
    assert rows(current_cube(spark, str(base), str(state))) == want
    assert compact(spark, str(state)) == 1
    assert rows(current_cube(spark, str(base), str(state))) == want


def test_lookup_last_wins(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    dim = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, name string, ord int")
    got = {r.k: r.name for r in lookup(df, dim, "k", last_wins_order="ord").collect()}
    assert got == {1: "b", 2: "c", 3: None}


def test_cube_prep_writes_totals(spark, tmp_path):
    out = cube_prep(load_tables(spark, SF_SMALL), str(tmp_path))
    n_dest = spark.read.parquet(f"{tmp_path}/dest_totals").count()
    assert n_dest == out["od_cube"].select("dest_cnty").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/region_totals").count() > 0
    before, after = (spark.read.parquet(f"{tmp_path}/{n}").orderBy("geoid").collect() for n in ("county_centroids", "thinned_centroids"))
    assert len(before) == len(after) == spark.read.parquet(f"{tmp_path}/county_names").count()
    assert all(abs(a.lon - b.lon) < 1e-9 and abs(a.lat - b.lat) < 1e-9 for a, b in zip(before, after))
    assert spark.read.parquet(f"{tmp_path}/region_counties").count() == load_tables(spark, SF_SMALL).supplier.count()


def test_stored_pairs_equal_aggregated_cube(spark):
    from freightcube.operators.cube import PAIR_KEYS, od_pairs
    t = load_tables(spark, SF_SMALL)
    stored = star.stored_od_pairs(t)
    key = lambda df: sorted(tuple(r[c] for c in PAIR_KEYS + ["tons"]) for r in df.collect())
    assert key(stored) == key(od_pairs(star.od_cube(t)))
    assert stored.inputFiles() == star.stored_od_pairs(t).inputFiles()   # reused, not rebuilt


def test_compact_without_epochs(spark, tmp_path):
    assert compact(spark, str(tmp_path / "nothing")) is None
