"""Near duplicates, mixing, neighbours, pages and the pipeline: against brute force on small tables."""

import re

import numpy as np
import pandas as pd
import pytest
from cardloom.llm import ann, html_extract, mixing, near_dedup
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, n, percent):
    """doc_id: (set size, smallest id reachable), by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def copies(spark):
    rng = np.random.default_rng(5)
    rows, words = [], [f"w{i}" for i in range(300)]
    for base in range(25):
        text = list(rng.choice(words, rng.integers(3, 120)))
        rows.append((base * 100, " ".join(text)))
        for k in range(1, int(rng.integers(1, 14))):
            near = list(text)
            for _ in range(int(rng.integers(0, max(2, len(text) // 12)))):
                near[rng.integers(0, len(near))] = str(rng.choice(words))
            rows.append((base * 100 + k, " ".join(near).upper() if k % 5 == 0 else " ".join(near)))
    # a chain: each text shares nine tenths with the one before
    chain = [f"c{i}" for i in range(160)]
    rows += [(9000 + k, " ".join(chain[k * 6 : k * 6 + 60])) for k in range(12)]
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_groups_are_those_of_all_pairs(spark, copies, n):
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in copies], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, n, 80).collect()}
    assert got == groups(copies, n, 80)


def test_large_nodes_branch_and_keep_all_links(spark, copies, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in copies], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 2, 80).collect()}
    assert got == groups(copies, 2, 80)


def test_a_large_family_near_the_threshold_is_compared_in_cells(spark, monkeypatch):
    # pages of one template, three quarters alike: one family without links, and two pages that are
    monkeypatch.setattr(near_dedup, "SMALL", 64)
    rng = np.random.default_rng(15)
    template = [f"t{i}" for i in range(90)]
    rows = [(i, " ".join([*template[:45], *(f"u{i}x{k}" for k in range(16)), *template[45:]])) for i in range(400)]
    rows += [(1000 + i, rows[i][1].replace(f"u{i}x3", "other")) for i in range(0, 400, 40)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 2, 80).collect()}
    assert got == groups(rows, 2, 80) and got[1000][1] == 0


def test_cells_hold_all_pairs_of_rows_and_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 10)
    rows = spark.range(137).selectExpr("7L AS node", "id AS rep", "CASE WHEN id < 80 THEN -1L ELSE id END AS comp", "1L AS mass")
    cells = {}
    for r in near_dedup.blocked(near_dedup.mixed(rows, "node"), "node").collect():
        cells.setdefault(r["path"], []).append((r["rep"], r["side"]))
    met = set()
    for c in cells.values():
        assert len(c) <= 50
        met |= {(min(a, b), max(a, b)) for a, x in c for b, y in c if a != b and near_dedup._MEETS[x] == y}
    assert met == {(a, b) for b in range(80, 137) for a in range(b)}


def test_intersections_counted_at_once():
    rng = np.random.default_rng(16)
    sets = [np.sort(rng.choice(400, rng.integers(1, 90), replace=False)).astype(np.uint64) for _ in range(150)]
    held = near_dedup._Sets(np.r_[0, np.cumsum([len(x) for x in sets])], np.concatenate(sets))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]
    all_ = held.counted(often=40, at_once=64)
    assert all(all_[i, j] == want[i][j] for i in range(150) for j in range(150) if i != j)
    for i in range(149):
        assert held.with_row(i, np.arange(i + 1, 150)).tolist() == want[i][i + 1 :]
    assert held.all is not None


def test_sets_whose_names_clash_stay_apart(spark, copies, monkeypatch):
    monkeypatch.setattr(near_dedup, "short_name", lambda digest: F.pmod(F.xxhash64(digest), F.lit(40)))
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in copies[:120]], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 2, 80).collect()}
    assert got == groups(copies[:120], 2, 80)


def test_components_that_do_not_settle_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="still moved"):
        near_dedup.components(links, rounds=1)


def test_one_row_of_each_group_stays(odd, no_docs, spark):
    kept = near_dedup.one_of_each(odd, 2, 80)
    assert kept.columns == odd.columns
    # of equal rows, of copies with other ids and of the row without id one stays; rows without words stay
    assert sorted((r["doc_id"] or -1, r["source"]) for r in kept.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).collect()) == [(-1, "b"), (1, ""), (2, "a"), (3, "a"), (5, ""), (6, "a"), (7, "b"), (9, "b")]
    twice = spark.createDataFrame([(1, "a b c d e f g", "en", "x", 0), (1, "quite other words stand in this text", "en", "x", 0), (None, "a b c d e f g", "en", "x", 0)], DOCS)
    assert sorted(r["text"][:5] for r in near_dedup.one_of_each(twice, 2, 80).collect()) == ["a b c", "quite"]
    assert near_dedup.one_of_each(no_docs, 2, 80).count() == 0


def test_components_follow_chains(spark):
    rng = np.random.default_rng(6)
    order = rng.permutation(200).tolist()
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(500, 501)], "a long, b long")
    got = {r["rep"]: r["comp"] for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_components_of_links_in_chunks(spark, monkeypatch, chunk):
    # chains up, down and in any order, a star, a ring, and one link given many times both ways
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    any_order = (1000 + rng.permutation(40)).tolist()
    links = [(i, i + 1) for i in range(30)] + [(131 - i, 130 - i) for i in range(30)] + list(zip(any_order, any_order[1:], strict=False))
    links += [(-(2**62) - i, 2**62) for i in range(20)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(7000, 6000), (6000, 7000)] * 9 + [(5, 5), (8000, 8000)]
    root = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([links[i] for i in rng.permutation(len(links))], "a long, b long")
    assert {r["rep"]: r["comp"] for r in near_dedup.components(df).collect()} == root
    assert near_dedup.components(df.limit(0)).count() == 0


def test_components_of_links_that_meet_take_one_shuffle(spark, monkeypatch):
    links = [(k, 1000 * k + i) for k in range(1, 9) for i in range(60)] + [(1, 2)]
    links = near_dedup.cut(spark.createDataFrame(links, "a long, b long").coalesce(1), "links")
    tables, real = [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df, name: tables.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or real(df, name))
    got = {r["rep"]: r["comp"] for r in near_dedup.components(links).collect()}
    comp = {k: 1 if k == 2 else k for k in range(1, 9)}
    assert got == comp | {1000 * k + i: comp[k] for k in comp for i in range(60)}
    assert tables == [1]


def test_near_duplicates_of_odd_rows(odd, no_docs):
    rows = [tuple(r) for r in near_dedup.near_duplicates(odd, 2, 80).collect()]
    assert len(rows) == odd.count()
    by = {r[0]: r for r in rows}
    assert by[1] == (1, 0, 1, True) and by[2][1] == 0 and by[5][1] == 0 and by[3] == (3, 1, 3, True) and by[4] == (4, 1, 3, False)
    assert by[10] == (10, 6, 9, False) and by[None][2:] == (None, True)
    assert near_dedup.near_duplicates(no_docs, 2, 80).count() == 0


def plain_targets(sizes):
    left, free, out = sum(sizes.values()), set(sizes), {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= set(over)
    return out


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(n)), "en", s, 0) for i, (n, s) in enumerate(zip(rng.integers(0, 90, 600), rng.choice(["big", "mid", "tiny", "Z", None], 600, p=[0.6, 0.2, 0.01, 0.15, 0.04]), strict=True))]
    df = spark.createDataFrame([(i, t, la, None if s is None or s == "None" else str(s), n) for i, t, la, s, n in rows], DOCS)
    got = mixing.mix(df, block=64).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    assert len(got) == 600 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
    again = mixing.mix(df.repartition(5), block=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # what each document gives, by walking its source's blocks pass after pass
    for s in sizes:
        left, mine, size = round(want[s]), [r for r in got if r["source"] == s and r["size"]], sizes[s]
        assert sorted(r["start"] for r in mine) == [sum(q["size"] for q in mine if q["start"] < r["start"]) for r in sorted(mine, key=lambda r: r["start"])]
        for r in mine:
            at = range(r["start"], r["start"] + r["size"])
            assert abs(r["taken"] - sum(left // size + (x < left % size) for x in at)) <= 1


def test_equal_rows_and_clashing_ids_are_repeated_by_themselves(spark):
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "y", 5), (1, "a b c", "en", "y", 5), (None, "a b c", "en", "x", 5), (None, "a b c", "en", "y", 5), (2, None, "en", "x", 0)]
    df = spark.createDataFrame(rows, DOCS)
    taken = {}
    for r in mixing.mix(df, row=F.struct("doc_id", "source")).collect():
        key = (r["row"]["doc_id"], r["source"])
        taken[key] = taken.get(key, 0) + r["taken"]
    got = {}
    for r in mixing.repeated(df).collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert got == {k: round(v / 3) for k, v in taken.items() if round(v / 3)}


def test_schedule_keeps_the_shares_all_along(spark):
    plan = spark.createDataFrame([("a", 6400, 6400.0), ("b", 3200, 1600.0), ("c", 640, 1920.0)], "source string, source_size long, target double")
    slots = sorted(mixing.schedule(plan, 64).collect(), key=lambda r: (r["slot"], r["rank"]))
    assert len(slots) == 100 + 25 + 30
    half = [r["source"] for r in slots[: len(slots) // 2]]
    assert all(abs(half.count(s) - n / 2) <= 3 for s, n in (("a", 100), ("b", 25), ("c", 30)))
    assert {(r["source"], r["pass"], r["block"]) for r in slots if r["source"] == "c"} == {("c", p, b) for p in range(3) for b in range(10)}


def test_mix_of_odd_rows(odd, no_docs):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd).where("taken > 3 * size").count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.repeated(odd).columns == odd.columns and mixing.repeated(no_docs).count() == 0


def test_neighbours_reach_the_recall_asked_for(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:710] = x[700]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    old, ann.LIST_ROWS = ann.LIST_ROWS, 100
    try:
        got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    finally:
        ann.LIST_ROWS = old
    hits = 0
    for q in range(0, 1500, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in mine] == list(range(1, 21))
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        hits += len({v for _, v, _ in mine} & set(want.tolist()))
        assert all(abs(c - s[v]) < 1e-9 for _, v, c in mine)
        assert [(-c, v) for _, v, c in mine] == sorted((-c, v) for _, v, c in mine)
    assert hits >= 0.95 * 75 * 20


def test_scan_without_abandonment_is_exact():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(400, 40)), rng.normal(size=(7, 40))
    plan = ann.planned(x, float(np.sqrt((x * x).sum(1).max())), 400, 5)
    for i, (places, scores) in enumerate(ann.scan(q, x, np.zeros((7, 400), bool), 5, plan)):
        best = np.argsort(-(x @ q[i]))[:5]
        assert len(set(best.tolist()) & set(places.tolist())) >= 4 and np.allclose(scores, x[places] @ q[i])


def test_scan_keeps_the_nearest_found_so_far():
    # 20 rows that differ from the query in the first columns only, and are nearest; 80 that differ further on too
    e = np.eye(40)
    near = [0.5 * e[0] + s * 0.75**0.5 * e[j] for j in range(1, 11) for s in (1, -1)]
    far = [-0.1 * e[0] + s * (0.99 / 2) ** 0.5 * (e[i] + t * e[j]) for i, j in zip(range(20, 40), range(19, 39), strict=True) for s in (1, -1) for t in (1, -1)]
    plan = ann.Plan(np.eye(41), np.zeros((1, 41)), 1.0, 1)
    ((places, _),) = ann.scan(e[:1], np.asarray(near + far), np.zeros((1, 100), bool), 20, plan)
    assert set(places.tolist()) == set(range(20))


@pytest.mark.parametrize("enough", [4, 0])
def test_every_query_gets_all_its_rows(spark, monkeypatch, enough):
    # copies that need one list each set the number of probes; outliers lie in tiny lists
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    monkeypatch.setattr(ann, "ENOUGH", enough, raising=False)
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(1, 24)), 2000, axis=0)
    x[::100] = rng.normal(size=(20, 24)) * 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), k=20).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {q: 20 for q in range(0, 2000, 50)}


def test_queries_that_share_an_id_have_lists_of_their_own(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, x[0].tolist()), (0, (-x[0]).tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, asked, k=4).collect()
    want = {(r, int(v)) for q in (x[0], -x[0]) for r, v in enumerate(sorted(range(1, 60), key=lambda i, q=q: -(x[i] @ q))[:4], 1)}
    assert len(got) == 8 and {(r["rank"], r["vec_id"]) for r in got} == want


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(13)
    for size in (1e200, 1e-200):
        x = rng.normal(size=(50, 6)) * size
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.nearest(df, df.where("vec_id = 0"), k=3).collect()
        assert len(got) == 3
    y = rng.normal(size=(50, 6)) * 1e160
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>").where("vec_id > 0")
    q = spark.createDataFrame([(0, (y[0] / 1e160).tolist())], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(df, q, k=3).orderBy("rank").collect()] == sorted(range(1, 50), key=lambda i: -(y[i] / 1e160) @ (y[0] / 1e160))[:3]


def test_recall_with_many_lists(spark):
    # 50,000 rows around 300 centers, in a dozen lists
    rng = np.random.default_rng(14)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, 50_000)] + 0.5 * rng.normal(size=(50_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(8)
    got = ann.nearest(df, df.where("vec_id % 500 = 0"), k=20).toPandas()
    hits, y = 0, x.astype(float)
    for q in range(0, 50_000, 500):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(got.vec_id[got.query_id == q]) & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == 2000 and hits >= 0.95 * 2000


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (8, [0.5, 0.0]), (9, [0.5, 0.0]), (20, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id in (0, 3)"), k=20).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 20, 2.0), (0, 3, 8, 0.5), (0, 4, 9, 0.5)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><div>Site</div></header><nav><ul><li><a href='/x'>menu</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><main><article><h1>Title &amp; more</h1><script>var a='<p>no</p>';</script><p>First <b>bold\n  text</b> here<br>goes on, at some length to be sure.<p>Second&nbsp;one &lt;ok&gt;</p>"
    "<div class='ad'>Buy</div><ul><li>item one<li>item two</ul><form><input>send</form><section id='comments'><p>me too</p></section></article></main><aside>Side</aside><footer>&copy; x</footer></body></html>"
)


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "Title & more\n\nFirst bold text here goes on, at some length to be sure.\n\nSecond one <ok>\n\nitem one\n\nitem two"


def test_density_finds_the_article_without_its_tag():
    page = PAGE.replace("main>", "div>").replace("article>", "section>")
    assert html_extract.main_text(page).startswith("Title & more\n\nFirst bold")
    prose = "<p>" + "Long prose, sentence after sentence. " * 8 + "</p>"
    links = "".join(f"<div><a href='{i}'>link number {i}</a></div>" for i in range(30))
    page = f"<body><div>{links}</div><div><h2>Head</h2>{prose * 3}</div></body>"
    assert html_extract.main_text(page).startswith("Head\n\nLong prose") and "link number" not in html_extract.main_text(page)


def test_pages_cut_off_and_odd(spark):
    cases = ["", None, "plain text only", "<p>open", "<p>cut &am", "<p>cut &amp", "<div class=\"x", "</p></div>stray", "<<<>>>", "<p>a</p>" * 3, "<b>" * 5000 + "deep", "<body></body>", "<!-- never closed <p>x</p>"]
    df = spark.createDataFrame([(i, "u", c) for i, c in enumerate(cases)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()}
    texts = [got[i][0] for i in range(len(cases))]
    assert texts[:6] == ["", "", "plain text only", "open", "cut &am", "cut &"] and texts[7] == "stray" and texts[9] == "a\n\na\n\na" and texts[10] == "deep" and texts[11:] == ["", ""]
    assert all(n == len(t) for t, n in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pipeline_stages_pass_on_what_they_keep(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, d)
        n, m = rows.count(), out.count()
        if name != "packing":
            assert out.columns == docs.columns and 0 < m
            assert m <= n if name in ("toxicity", "near_dedup") else m == n if name == "pii" else m <= 3 * n
            rows = out
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, d).count() == m
