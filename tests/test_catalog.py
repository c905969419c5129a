import duckdb
import pytest

import __spark_entry__
from shotloom.plans import catalog

#: One of each kind; the whole catalogue runs in the driver's comparison.
SOME = ["player_conversion", "student_t", "welch_t", "shots_by_team", "list_matches_page", "dedup_first", "shot_dataset", "goals_by_player", "team_conversion", "describe_by_group", "mann_whitney", "chi_square_yates", "fisher_exact", "bootstrap_strata", "permutation_clusters", "probability_metrics", "group_split", "dagostino_k2", "cramers_v_corrected", "two_proportion_z", "beta_binomial", "compare_model_metrics", "keys_with_all", "phase_means", "ecdf", "ordered_target_stat"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, duck, name):
    own, sql = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    rows = lambda df: sorted(map(repr, (tuple(None if x != x else x for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))))
    assert rows(own) == rows(sql)


@pytest.mark.parametrize("name", ["fisher_exact_all", "finishing_family_all"])
def test_whole_finishing_family(spark, sf, duck, name):
    test_against_sql(spark, sf, duck, name)
    shots = catalog.load(spark, sf, "shots").groupBy("player_id").count().where("count >= 15").count()
    own = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(own) == shots > catalog.QUERIES["fisher_exact"](spark, sf).count()
    if "bonferroni" in own:
        small = own[own.p_value > 0.0001]
        assert (small.bonferroni - (small.p_value * shots).clip(upper=1)).abs().max() < 1e-5 * shots


@pytest.mark.parametrize("name", ["bootstrap_clusters", "bootstrap_strata", "permutation_clusters"])
def test_all_replicates(spark, sf, duck, name):
    whole = catalog.QUERIES[f"{name}_all"](spark, sf).toPandas().set_index("replicate").iloc[:, 0]
    some = catalog.QUERIES[name](spark, sf).toPandas().set_index("replicate").iloc[:, 0]
    assert sorted(whole.index) == list(range(1, 10_001)) and (whole[some.index] == some).all()
    # means that are halves of the last place may round either way, as the engines add in other orders
    sql = duck.execute(catalog.ORACLES[f"{name}_all"]).df().set_index("replicate").iloc[:, 0]
    assert (whole - sql[whole.index]).abs().max() < 1.5e-4


def test_permutation_summary_has_all_replicates(spark, sf):
    assert catalog.QUERIES["permutation_summary"](spark, sf).first().replicates == 10_000


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
