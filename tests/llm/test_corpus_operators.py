"""The corpus operators against brute force and their stated limits."""

import random
import unicodedata
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelstone.llm import queries
from keelstone.llm.mixing import mix, route
from keelstone.llm.packing import cut_item, pack, pack_group
from keelstone.llm.textforms import comparison_form, fold, page_form, same_on_the_page, text_digests, unify_text
from keelstone.llm.tokens import DEFAULT_VOCABULARY, count_tokens, encoder

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
needs_vocabulary = pytest.mark.skipif(not Path(DEFAULT_VOCABULARY).exists(), reason="no tokenizer files")

# 8: text forms

SAME = [
    ("café", "café"), ("Ａｂ１", "Ab1"), ("ﬁn", "fin"), ("a​b­", "ab"), ("a b c　d", "a b c d"),
    ("sаy", "say"), ("Οut", "Out"), ("іѕ", "is"), ("K", "K"), ("а́", "á"), ("​", ""), ("a b", "a\nb"),
]
DIFFERENT = [("A", "a"), ("e", "é"), ("m²", "m2"), ("½", "1/2"), ("straße", "strasse"), ("a\nb", "a b"), ("a  b", "a b"), ("1", "2")]


def test_page_form():
    for a, b in SAME:
        assert page_form(a) == page_form(b) and comparison_form(a) == comparison_form(b)
    for a, b in DIFFERENT:
        assert page_form(a) != page_form(b)
    assert comparison_form("STRAßE m² ﬃ") == "strasse m2 ffi"


@hyp(max_examples=200, deadline=None)
@given(st.text())
def test_forms_are_stable_and_nested(text):
    text = text.encode("utf-8", "ignore").decode()
    page = page_form(text)
    assert page_form(page) == page and unicodedata.is_normalized("NFC", page)
    assert fold(page) == comparison_form(text)
    from keelstone.llm import textforms

    plain = unicodedata.normalize("NFD", textforms._RETURNS.sub("\n", text)).translate(textforms._PAGE_TABLE)
    assert page == unicodedata.normalize("NFC", plain)  # as if every text were decomposed and mapped


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    base = ["The question was put.", "", "Order", "x" * 50_000] + [f"speech {i}" for i in range(6)]
    texts = [None, None] + [rng.choice(base) for _ in range(60)]
    texts += [t.replace("e", "е", 1) + rng.choice(["", "​"]) for t in texts if t][:25] + [t.upper() for t in base]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "Order")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("as_written", F.lit(1))
    found = [tuple(r) for r in same_on_the_page(text_digests(df, "doc_id", "text")).collect()]
    known = [(i, t) for i, t in data if i is not None and t is not None]
    wanted = {(a, b) for (a, s), (b, t) in combinations(known, 2) if s != t and page_form(s) == page_form(t)}
    assert len(found) == len(set(found)) and set(found) == wanted and wanted
    assert same_on_the_page(text_digests(df.limit(0), "doc_id", "text")).count() == 0


def test_large_classes_are_paired_in_parts(spark, monkeypatch):
    """A class of 30 spellings, one of them with 200 copies, cut into small parts."""
    from keelstone.llm import textforms

    monkeypatch.setattr(textforms, "PAIRED_ROWS", 7)
    spellings = ["order" + "\u200b" * i for i in range(30)]
    texts = spellings + [spellings[3]] * 199 + ["Order"] * 3 + ["other"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    digests = text_digests(df, "id", "text")
    found = [tuple(r) for r in same_on_the_page(digests).collect()]
    wanted = {(a, b) for (a, s), (b, t) in combinations(enumerate(texts), 2) if s != t and page_form(s) == page_form(t)}
    assert len(found) == len(set(found)) and set(found) == wanted
    classes = textforms.look_alikes(digests).collect()
    assert sorted(r["id"] for r in classes) == list(range(30)) and len({r["as_seen"] for r in classes}) == 1
    assert {r["id"]: r["copies"] for r in classes}[3] == 200


def test_unify_keeps_rows(spark):
    df = spark.createDataFrame([(1, "Ａß"), (2, None), (3, ""), (3, "")], "id int, text string")
    assert sorted(map(tuple, unify_text(df, "text").collect()), key=repr) == sorted([(1, "ass"), (2, None), (3, ""), (3, "")], key=repr)
    assert unify_text(df, "text", "page").where("id = 1").first()["text"] == "Aß"


@needs_data
def test_p8_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    wanted = {(min(a, b), max(a, b)) for (a, s), (b, t) in combinations(map(tuple, rows), 2) if s != t and page_form(s) == page_form(t)}
    assert {tuple(r) for r in queries.p8_found(spark, DATA).collect()} == wanted


# tokens


@needs_vocabulary
def test_counts_are_of_whole_texts(spark):
    texts = ["hello (Applause.) world", "", None, "long " * 30_000, "a [x] (y)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("tokens", F.lit("clash"))
    found = {r["id"]: (r["tokens"], r["loss_tokens"]) for r in count_tokens(df, "text").collect()}
    encode = encoder(DEFAULT_VOCABULARY).encode_ordinary
    assert {i: n for i, (n, _) in found.items()} == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert found[0][1] == len(encode(texts[0])) - len(encode("(Applause.)")) and found[1] == found[2] == (0, 0)


# 6: packing


@hyp(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 100)), max_size=80), st.integers(1, 6), st.integers(50, 100))
def test_group_keeps_every_limit(items, segments, loss_capacity):
    tokens = np.array([t for t, _ in items], np.int64)
    loss = np.array([min(t, x, loss_capacity) for t, x in items], np.int64)
    place = pack_group(tokens, loss, 100, segments, loss_capacity)
    for b in set(place.tolist()):
        own = place == b
        assert b >= 0 and tokens[own].sum() <= 100 and own.sum() <= segments and loss[own].sum() <= loss_capacity
    if segments >= 100 // 1 and len(items):
        assert place.max() + 1 <= 2 * -(-tokens.sum() // 100)


def test_items_that_fit_exactly_are_paired():
    tokens = np.array([90, 80, 70, 60, 40, 30, 20, 10])
    assert pack_group(tokens, tokens, 100, 9, 100).max() == 3


def test_pack_places_all_tokens(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 700)]), None) for i in range(400)]
    data = [(i, t, rng.randrange(0, t + 1)) for i, t, _ in data] + [(900, 0, 0), (901, None, None), (902, 300, 300), (902, 300, 300), (903, 100, 100)]
    items = spark.createDataFrame(data, "id int, tokens long, loss_tokens long").withColumn("capacity", F.lit("clash"))
    budgets = spark.createDataFrame([("a", 100), ("b", 256), ("off", 0), (None, 5)], "budget_name string, capacity_tokens long")
    for share in (1.0, 0.5):
        placed = [r.asDict() for r in pack(spark, items, budgets, "id", loss_share=share, group_items=100).collect()]
        for name, capacity in (("a", 100), ("b", 256)):
            own = [r for r in placed if r["budget_name"] == name]
            boxes = {}
            for r in own:
                boxes.setdefault(r["container_id"], []).append(r)
            assert len(boxes.pop(None)) == 2
            for rows in boxes.values():
                assert sum(r["tokens"] for r in rows) <= capacity and len(rows) <= max(1, capacity // 16)
                assert sum(r["loss_tokens"] for r in rows) <= int(capacity * share)
            for i in {d[0] for d in data}:
                parts = [r for r in own if r["id"] == i]
                copies = [d for d in data if d[0] == i]
                assert sum(r["tokens"] for r in parts) == sum(d[1] or 0 for d in copies)
                assert sum(r["loss_tokens"] for r in parts) == sum(d[2] or 0 for d in copies)
                if len(copies) == 1 and copies[0][1]:
                    at = 0
                    for r in sorted(parts, key=lambda r: r["piece"]):
                        assert r["first_token"] == at
                        at += r["tokens"]
                    if copies[0][1] <= capacity and copies[0][2] <= int(capacity * share):
                        assert len(parts) == 1
            if share == 1.0:
                total = sum(r["tokens"] for r in own)
                assert len(boxes) <= 1.1 * -(-total // capacity)
    assert pack(spark, items.limit(0), budgets, "id").count() == 0
    assert pack(spark, items, budgets.limit(0), "id").count() == 0


@hyp(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 40)), max_size=6), st.integers(1, 90), st.integers(1, 90))
def test_cut_pieces_are_as_few_as_fit(tokens, gaps, capacity, loss_capacity):
    runs, at = [], 0
    for gap, n in gaps:
        at += gap
        n = min(n, tokens - at)
        if n <= 0:
            break
        runs += [at, n]
        at += n
    bears = np.ones(tokens, int)
    for a, n in zip(runs[0::2], runs[1::2]):
        bears[a : a + n] = 0
    pieces = cut_item(tokens, runs, capacity, loss_capacity)
    assert [p[0] for p in pieces] == list(np.cumsum([0, *[p[1] for p in pieces]]))[:-1] and sum(p[1] for p in pieces) == tokens
    for first, n, loss in pieces:
        assert 0 < n <= capacity and loss == bears[first : first + n].sum() <= loss_capacity
    for first, n, _ in pieces[:-1]:  # one more token would break a limit, so fewer pieces are impossible
        assert n == capacity or bears[first : first + n + 1].sum() > loss_capacity


@needs_vocabulary
def test_quiet_tokens_stand_where_the_remarks_are(spark):
    texts = ["Order (Applause.) and [laughter é] more", "(all)", "none", "tail (x)", "", None, "ß" * 40 + " (é) " + "word " * 50]
    df = spark.createDataFrame([(i, t, i != 2) for i, t in enumerate(texts)], "id int, text string, own boolean")
    known = encoder(DEFAULT_VOCABULARY)
    for r in count_tokens(df, "text", learned="own").collect():
        tokens, runs = known.encode_ordinary(texts[r["id"]] or ""), list(zip(r["quiet"][0::2], r["quiet"][1::2]))
        said = [known.decode(tokens[a : a + n]).strip() for a, n in runs]
        assert r["tokens"] == len(tokens) and r["loss_tokens"] == len(tokens) - sum(n for _, n in runs)
        assert said == {0: ["(Applause.)", "[laughter é]"], 1: ["(all)"], 2: ["none"], 3: ["(x)"], 6: ["(é)"]}.get(r["id"], [])


@needs_data
@needs_vocabulary
def test_three_limits_bind_and_hold(spark):
    closed = {r["budget_name"]: r for r in queries.p6_limits(spark, DATA).collect()}
    assert len(closed) == 4
    for cause in ("full_of_tokens", "full_of_items", "full_of_loss"):
        assert sum(r[cause] for r in closed.values()) > 0, cause
    fill = {r["budget_name"]: r["unused_share"] for r in queries.p6_fill(spark, DATA).collect()}
    assert all(fill[b] <= closed[b]["unused_share"] + 1e-9 for b in fill)  # tokens alone leave less space unused
    for r in queries.p6_checked(spark, DATA).collect():
        assert (r["over_limit"], r["changed"], r["split_in_vain"]) == (0, 0, 0)
    for r in queries.p7_checked(spark, DATA).collect():
        assert (r["over_cap"], r["of_others"], r["off_share"]) == (0, 0, 0), r


# 7: mixing


def test_route_prefers_few_repetitions():
    total, flow = route({("a",): 100, ("b",): 1000, ("a", "b"): 50}, {"a": (0.5, 3), "b": (0.5, 1), "none": (0.2, 5)})
    used = {s: sum(n for (_, x), n in flow.items() if x == s) for s in ("a", "b")}
    assert used["a"] == used["b"] == int(0.5 * total) == 450
    assert flow[("a",), "a"] == 300 and flow[("a", "b"), "a"] == 150
    total, flow = route({("a",): 100, ("a", "b"): 100}, {"a": (0.5, 2), "b": (0.5, 2)}, total=200)
    assert flow == {(("a",), "a"): 100, (("a", "b"), "b"): 100}
    assert route({}, {"a": (1.0, 1)}) == (0, {}) and route({("a",): 5}, {}) == (0, {})


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(4)
    data = []
    for i in range(3000):
        source = rng.choice(["Big Hall"] * 6 + ["BIG  hall", "Small", "small ", "Mid", "Unknown", None, " "])
        data.append((i, source, bytes([i % 250, i // 250]), rng.randrange(1, 40)))
    data += [(10_000 + i, "Mid", bytes([i, 0]), data[i][3]) for i in range(200)]  # printed elsewhere too
    data += [(20_000, "Mid", None, 5), (20_001, "Mid", b"zz", 0), (20_002, "Mid", b"zy", None), (None, "Mid", b"zx", 9)]
    df = spark.createDataFrame(data, "doc_id long, source string, digest binary, tokens long")
    targets = spark.createDataFrame([("big hall", 0.5, 1), ("SMALL", 0.3, 4), ("Mid", 0.15, 2), ("Absent", 0.05, 9)], "source string, target_share double, max_repeats int")
    chosen, report = mix(spark, df, targets, "doc_id")
    rows, caps = chosen.collect(), {"big hall": 1, "small": 4, "mid": 2}
    assert {r["source"] for r in rows} == set(caps) and all(1 <= r["repeats"] <= caps[r["source"]] for r in rows)
    assert len({(r["doc_id"], r["source"]) for r in rows}) == len(rows) and all(r["doc_id"] is not None for r in rows)
    tokens = {s: sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == s) for s in caps}
    whole = sum(tokens.values())
    for s, share in (("big hall", 0.5), ("small", 0.3), ("mid", 0.15)):
        assert abs(tokens[s] / whole - share / 0.95) < 0.01
    told = {r["source"]: r for r in report.collect()}
    assert set(told) == {"big hall", "small", "mid", "absent", "unknown", None} and told["absent"]["chosen_tokens"] == 0
    assert told["small"]["chosen_tokens"] == tokens["small"]
    assert sorted(map(tuple, mix(spark, df, targets, "doc_id")[0].collect())) == sorted(map(tuple, rows))
    assert mix(spark, df.limit(0), targets, "doc_id")[0].count() == 0
    assert mix(spark, df, targets.limit(0), "doc_id")[0].count() == 0


@needs_data
@needs_vocabulary
def test_queries_run_on_whole_and_empty_tables(spark, tmp_path):
    for f in Path(DATA).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(f"{tmp_path}/{f.name}")
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert queries.p6_pack(spark, DATA).where("budget_name = 'tiny'").select("doc_id").distinct().count() == documents
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
