"""Materialized views: refresh, staleness, and which queries they answer."""

import pytest

from keelstone import catalog
from keelstone.errors import EngineError, UnsupportedError
from keelstone.lake import Table
from keelstone.plans import views

SIMPLE = "select key as k, value, range from keel.m1 where range >= 11 and range < 30 and value <> 'zz'"
JOIN = "select a.key, a.value as v1, b.value as v2, a.range as r1 from keel.m1 a join keel.m2 b on a.key = b.key where a.range > 5"
THREE = "select m1.key, m3.k2, m2.value from keel.m1 m1, keel.m2 m2, keel.m3 m3 where m1.key = m2.key and m2.key = m3.k1 and m1.range > 5"
LEFT = "select a.key, a.value, b.value as other from keel.m1 a left join keel.m2 b on a.key = b.key where a.range > 5"
GROUP = "select k1, range, max(k2) as top, count(*) as n from keel.m3 where k1 > 0 group by k1, range"
GROUP_LEFT = "select a.key, max(b.value) as top from keel.m1 a left join keel.m2 b on a.key = b.key where a.range > 5 group by a.key"
EITHER = "select key, value, range from keel.m1 where key < 3 or range > 20"
BOTH = "select key, value, range from keel.m1 where (key < 3 or range > 20) and value <> 'q'"

# (view, query, does the view answer it?)
CASES = [
    (SIMPLE, SIMPLE, True),
    (SIMPLE, "select key, upper(value) as u from keel.m1 where 11 <= range and 30 > range and value <> 'zz'", True),
    (SIMPLE, "select key from keel.m1 where range >= 10 and range < 30 and value <> 'zz'", False),
    (SIMPLE, "select key from keel.m1 where range >= 11 and range <= 30 and value <> 'zz'", False),
    (SIMPLE, "select key from keel.m1 where range >= 11 and value <> 'zz'", False),
    (SIMPLE, "select key from keel.m1 where range > 11 and range < 22 and value <> 'zz'", True),
    (SIMPLE, "select key from keel.m1 where range = 12 and value <> 'zz'", True),
    (SIMPLE, "select key + 1 as x from keel.m1 where range between 11 and 20 and value <> 'zz' and key > 1", True),
    (SIMPLE, "select key from keel.m1 where range in (11, 12) and value <> 'zz' and (key = 1 or key = 2)", True),
    (SIMPLE, "select key from keel.m1 where range in (11, 40) and value <> 'zz'", False),
    (SIMPLE, "select key from keel.m1 where range >= 11 and range < 30", False),
    (SIMPLE, "select key from keel.m3 k join keel.m1 m on k.k1 = m.key", False),
    (SIMPLE, "select key from keel.m1 where range = 12 and value <> 'zz' order by key limit 1", False),
    (SIMPLE, "select count(*) as n from keel.m1 where range = 12 and value <> 'zz'", False),
    (JOIN, JOIN, True),
    (JOIN, "select b.key, b.value as v2 from keel.m1 a join keel.m2 b on a.key = b.key where a.range > 10 and b.key > 1", True),
    (JOIN, "select a.key from keel.m1 a join keel.m2 b on a.key = b.key", False),
    (JOIN, "select a.key from keel.m1 a left join keel.m2 b on a.key = b.key where a.range > 5", False),
    (JOIN, "select a.key, b.range from keel.m1 a join keel.m2 b on a.key = b.key where a.range > 5", False),
    (THREE, THREE, True),
    (THREE, "select m3.k1 from keel.m1 m1 join keel.m2 m2 on m1.key = m2.key and m1.range > 7 join keel.m3 m3 on m1.key = m3.k1", False),
    (THREE, "select m3.k1, m2.value from keel.m1 m1 join keel.m2 m2 on m1.key = m2.key join keel.m3 m3 on m1.key = m3.k1 where m1.range > 5 and m3.k2 > 'a'", True),
    (THREE, "select m2.value from keel.m1 m1, keel.m2 m2, keel.m3 m3 where m1.key = m2.key and m1.range > 5", False),
    (LEFT, LEFT, True),
    (LEFT, "select a.key, b.value as other from keel.m1 a left join keel.m2 b on a.key = b.key where a.range > 5 and b.value is null", True),
    (LEFT, "select a.key from keel.m1 a left join keel.m2 b on a.key = b.key and b.range > 1 where a.range > 5", False),
    (GROUP, GROUP, True),
    (GROUP, GROUP + " having count(*) > 1 and max(k2) > 'a'", True),
    (GROUP, "select k1, n + 1 as m from (" + GROUP + ") where n > 1", True),
    (GROUP, "select k1, range, max(k2) as top from keel.m3 where k1 > 1 group by k1, range", False),
    (GROUP, "select k1, range, min(k2) as low from keel.m3 where k1 > 0 group by k1, range", False),
    (GROUP, "select k1, max(k2) as top from keel.m3 where k1 > 0 group by k1", False),
    (GROUP_LEFT, GROUP_LEFT, True),
    (GROUP_LEFT, GROUP_LEFT + " having max(b.value) is not null", True),
    (GROUP_LEFT, GROUP_LEFT.replace("a.range > 5", "a.range > 6"), False),
    (GROUP_LEFT, GROUP_LEFT.replace("a.key = b.key where", "a.key = b.key and b.key > 1 where"), False),
    (EITHER, EITHER, True),
    (EITHER, "select key from keel.m1 where key < 2 or range > 25", True),
    (EITHER, "select key from keel.m1 where key < 2", True),
    (EITHER, "select key from keel.m1 where range = 22 and value > 'a'", True),
    (EITHER, "select key from keel.m1 where key < 3 or range > 20 or value = 'b'", False),
    (EITHER, "select key from keel.m1 where key < 4 or range > 25", False),
    (EITHER, "select key from keel.m1 where range > 15", False),
    (EITHER, "select key from keel.m1", False),
    (BOTH, BOTH, True),
    (BOTH, "select key from keel.m1 where (key = 1 or range = 22) and value <> 'q' and key < 9", True),
    (BOTH, "select key from keel.m1 where key = 1 and value <> 'q'", True),
    (BOTH, "select key from keel.m1 where (key < 5 or range > 20) and value <> 'q'", False),
    (BOTH, "select key from keel.m1 where value <> 'q'", False),
    (BOTH, "select key from keel.m1 where key < 3 or range > 20", False),
]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("views")
    before = spark.conf.get("spark.keelstone.catalog.dir", None)
    spark.conf.set("spark.keelstone.catalog.dir", f"{root}/names")
    data = {
        "m1": ([(1, "a", 11), (2, "b", 11), (3, "c", 12), (4, "d", 22), (5, "q", 25)], "key int, value string, range int", {"range_partitions": "range", "hash_partitions": "key", "bucket_num": 2}),
        "m2": ([(1, "aa", 22), (3, "cc", 22), (5, "ee", 22), (6, "ff", 22)], "key int, value string, range int", {}),
        "m3": ([(i % 4, f"k{i % 3}", f"v{i}", 30 + i % 2) for i in range(12)], "k1 int, k2 string, value string, range int", {"range_partitions": "range"}),
    }
    for name, (rows, ddl, layout) in data.items():
        Table(spark, f"{root}/{name}").write(spark.createDataFrame(rows, ddl), short_name=name, **layout)
    yield root
    spark.conf.unset("spark.keelstone.catalog.dir") if before is None else spark.conf.set("spark.keelstone.catalog.dir", before)


def test_which_queries_a_view_answers(spark, sources):
    made = {}
    for view, query, expected in CASES:
        if view not in made:
            made[view] = views.description(spark, view)[0]
        try:
            found = views.match(views.description(spark, query)[0], made[view])
        except views.NotCovered:
            found = None
        assert (found is not None) == expected, (view, query, found)


def test_answers_are_right(spark, sources):
    stored = {}
    for i, view in enumerate(dict.fromkeys(v for v, _, _ in CASES)):
        stored[view] = views.create_view(spark, f"view{i}", f"{sources}/view{i}", view)
    wanted = lambda q: spark.sql(catalog._with_views(spark, q))
    for _, query, expected in CASES[::3]:
        answer = catalog.sql(spark, query)
        assert sorted(map(repr, answer.collect())) == sorted(map(repr, wanted(query).collect()))
        if expected:
            assert views.rewritten(spark, query) is not None
    for view in stored.values():
        view.dropTable()


def test_refresh_and_staleness(spark, sources, settings, tmp_path):
    source = Table(spark, f"{tmp_path}/s")
    source.write(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), hash_partitions="k", bucket_num=1, short_name="src")
    view = views.create_view(spark, "mv", f"{tmp_path}/mv", "select k, v from keel.src where v > 1")
    assert view.toDF().count() == 1 and not view.updateMaterialView()
    source.upsert(spark.createDataFrame([(1, 10)], "k int, v int"))
    with pytest.raises(EngineError, match="stale"):
        view.toDF()
    assert views.rewritten(spark, "select k from keel.src where v > 1") is None
    assert catalog.sql(spark, "select k from keel.src where v > 1").count() == 2
    settings("spark.keelstone.allow.stale.materialView", "true")
    assert view.toDF().count() == 1
    settings("spark.keelstone.allow.stale.materialView", "false")
    assert view.updateMaterialView() and view.toDF().count() == 2
    assert views.rewritten(spark, "select k from keel.src where v > 1") is not None
    settings("spark.keelstone.material.query.rewrite.enable", "false")
    assert views.rewritten(spark, "select k from keel.src where v > 1") is None
    for refused in (lambda: view.delete(), lambda: view.write(view.toDF(), "append"), lambda: view.update(set={"v": "1"}),
                    lambda: views.create_view(spark, "mv2", f"{tmp_path}/mv2", "select k from keel.mv"),
                    lambda: views.create_view(spark, "mv3", f"{tmp_path}/mv3", "select 1 as one")):
        with pytest.raises(UnsupportedError):
            refused()
    source.dropTable()
    assert not Table.isTable(spark, f"{tmp_path}/mv") and "mv" not in catalog.names(spark)
