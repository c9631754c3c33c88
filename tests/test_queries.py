"""Driver contract: entry() runs; selected registered queries equal their DuckDB oracle at sf0.001."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), 'tools'))

from conftest import SF_SMALL  # noqa: E402

KEYS = ['L6_normal_leads', 'L6_deprived_leads', 'A1_survey_kpis', 'A12_visit_summary', 'A18_keywords',
        'A19_bigrams', 'A24_sentiment_summary', 'J10_champion_edges', 'J11_nearest_site', 'A34_site_groups',
        'J16_geocode', 'L18_emerging_topics']


@pytest.fixture(scope='module')
def duck():
    from sitescope.plans.bindings import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert 'priority_score' in df.columns and 'gias_urn' in df.columns


def test_every_query_has_a_docstring_and_oracle_keys_exist():
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.parametrize('key', KEYS)
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    from oracle_check import digest
    sdf = E.queries()[key](spark, SF_SMALL).toPandas()
    odf = duck.execute(E.oracle_sql()[key]).df()
    c1, h1, _ = digest(sdf)
    c2, h2, _ = digest(odf)
    assert c1 == c2
    assert len(sdf) == len(odf)
    assert h1 == h2


def test_runner_records_status(spark, tmp_path):
    from sitescope.plans.runner import run_all
    st = {r.key: r for r in run_all(spark, SF_SMALL, str(tmp_path), keys=['A1_survey_kpis', 'A9_sessions_by_type'])
          .collect()}
    assert st['A1_survey_kpis'].status == 'ok' and st['A1_survey_kpis'].rows == 1
    assert st['A9_sessions_by_type'].rows == 5
    assert (tmp_path / '_status').exists()


def test_a_name_of_many_customers_is_typed_once_each_way(spark, tmp_path):
    """Rows of a repeated name are no product of its customers, their coordinates and the ways to type it."""
    import __spark_entry__ as E
    from sitescope.plans import q_match as Q
    n, d = 60, str(tmp_path)
    customers = [(k, 'Customer#%09d' % (123456000 + k // n), k // n % 2, 10.0) for k in range(3 * n)]
    customers += [(181, 'Customer#987654321', 1, 10.0), (182, 'Customer#555555555', 0, 10.0), (183, None, 0, 10.0)]
    orders = [(k, '1-URGENT', 'F', None) for k, *_ in customers for _ in range(1 if k == 182 else 2)] + [(182, '5-LOW', 'F', None)]
    spark.createDataFrame(customers, 'c_custkey long, c_name string, c_nationkey int, c_acctbal double').write.parquet(f'{d}/customer.parquet')
    spark.createDataFrame(orders, 'o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp').write.parquet(f'{d}/orders.parquet')
    spark.createDataFrame([(0, 'EAST'), (1, 'WEST')], 'n_nationkey int, n_name string').write.parquet(f'{d}/nation.parquet')
    names = ['Customer#%09d' % (123456000 + i) for i in range(3)]
    typed = sorted([*names, *(' ' + x.upper() for x in names), *(x[:12] + x[13:] for x in names), ' CUSTOMER#987654321'])
    champions = Q.L.champions_of(Q.vis(spark, d), 2)
    assert sorted(r.school_name for r in Q._typed_sites(spark, d, champions).select('school_name').limit(1000).collect()) == typed
    got = {tuple(r) for r in E.queries()['J18_typed_champion_trusts'](spark, d).collect()}
    assert got == {('EAST', 6, 2), ('WEST', 4, 1)}
    found = {r.school_name: (r.match_type, r.trust_name) for r in E.queries()['J15_trust_enrichment'](spark, d).collect()}
    assert set(typed) < set(found) and found['Customer#12356001'] == ('fuzzy', 'WEST') and found[names[2]] == ('exact', 'EAST')


def test_lines_of_both_lead_layers_and_of_the_nearest_cluster(spark, tmp_path):
    """V4: champions of normal and of deprived leads; trust sites, then members of the nearest cluster, five in all."""
    import __spark_entry__ as E
    from collections import Counter
    from oracle_check import digest
    d, con = str(tmp_path), duckdb.connect()
    customers = [(k, 'Site %02d' % k, (k > 10) + (k > 25), 5000.0 if k % 3 == 0 else 100.0) for k in range(1, 41)]
    orders = [(k, '1-URGENT', 'F', None) for k in (1, 2, 11) for _ in range(2)] + [(k, '5-LOW', 'O', None) for k in range(12, 31)]
    spark.createDataFrame(customers, 'c_custkey long, c_name string, c_nationkey int, c_acctbal double').write.parquet(f'{d}/customer.parquet')
    spark.createDataFrame(orders, 'o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp').write.parquet(f'{d}/orders.parquet')
    spark.createDataFrame([(0, 'EAST'), (1, 'WEST'), (2, 'NORTH')], 'n_nationkey int, n_name string').write.parquet(f'{d}/nation.parquet')
    for t in ('customer', 'orders', 'nation'):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    sql = E.oracle_sql()
    lines = E.queries()['V4_connection_lines'](spark, d).toPandas()
    assert digest(lines)[:2] == digest(con.execute(sql['V4_connection_lines']).df())[:2]

    deprived = lines[lines.colour == '#DC143C']
    assert Counter(deprived.gias_urn) == {k: 2 for k in range(1, 41) if k % 3 == 0}
    assert set(deprived.to_name) <= {'Site 01', 'Site 02', 'Site 11'} and deprived.label.str.startswith('Connection to Site').all()

    def apart(a, b, x, y):
        a, b, x, y = map(math.radians, (a, b, x, y))
        return math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2

    sites = con.execute(sql['M1_kmeans']).fetchall()
    leads = con.execute(sql['J12_nearest_centroid']).fetchall()
    assert len(sites) == 22 and {3, 10, 25} < {urn for urn, *_ in leads}
    for urn, lat, lon, nearest, _ in leads:
        own = lines[lines.gias_urn == urn].sort_values('rank')
        trust = list(own[own.edge_type == 'trust'].to_name)
        assert len(trust) == (2 if urn <= 10 else 1 if urn <= 25 else 0)
        near = sorted((apart(lat, lon, x, y), name) for name, x, y, c in sites if c == nearest and name not in trust)[:5 - len(trust)]
        cluster = own[own.edge_type == 'cluster']
        assert list(cluster.to_name) == [name for _, name in near]
        assert list(cluster['rank']) == [len(trust) + i for i in range(1, len(near) + 1)]
    cluster = lines[lines.edge_type == 'cluster']
    assert len(cluster) > 20 and set(cluster.colour) == {'orange'} and cluster.label.isna().all()
