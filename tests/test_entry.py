import duckdb
import pytest

import __spark_entry__ as entry
from scalewright import queries as fields

SF = "/root/testdata/sf0.001"
SHORT = ["filter_tophat_zerofill", "filter_gaussian_deformable", "filter_highorder3", "filter_3d", "pi_2d", "pi_spherical", "wlsq_gradient", "coarse_grain_slices", "spectral_fft", "analyze_sweep", "coarse_grain_auto", "pi_spectral", "pi_curvilinear", "tau_lcr_spherical", "pi_decomposed_3d", "filtering_spectrum_strict", "spectral_nusht", "filter_growing_grid", "filter_events_densified"]


def test_registered_names():
    assert set(fields.ORACLES) <= set(fields.QUERIES) <= set(entry.queries()) and set(fields.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SHORT)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(fields.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = fields.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_spherical_transform_takes_all_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    got = [tuple(r) for r in fields.QUERIES["spectral_sht"](spark, SF).select("i", "j", "u").collect()]
    assert len(got) == 66 and sorted(got) == sorted(con.execute(fields.ORACLES["spectral_sht"]).fetchall())
