"""Vector and conversation operators, components, the pipeline and the registered queries."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import chat, common, vectors


def table(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r], 0, 1.0) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double")


def cloud(n, d, seed, groups=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for g in range(groups):
        at = rng.choice(n, 15, replace=False)
        x[at] = x[at[0]] + rng.normal(size=(15, d)) * rng.uniform(0.05, 0.45)
    return x * rng.uniform(0.5, 2, size=(n, 1))


def brute_links(x, t=0.9):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T >= t
    comp = np.arange(len(x))
    while True:
        new = np.array([comp[s[i]].min() for i in range(len(x))])
        if (new == comp).all():
            return s.sum(1) - 1, comp
        comp = new


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "DATA_BLOCK", 32)  # lists of many blocks
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 48)
    x = cloud(600, 24, 1)
    x[17] = x[5]
    links, comp = brute_links(x)
    got = vectors.near_duplicates(table(spark, x)).toPandas().set_index("vec_id").sort_index()
    found = got["n_links"].to_numpy()
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum() > 0
    assert (got["component_id"].to_numpy() == comp).mean() > 0.99
    assert (got["kept"].to_numpy() == (got["component_id"].to_numpy() == got.index.to_numpy())).all()


def test_near_duplicates_of_low_rank_vectors(spark):
    """Eight directions of 256: neighbours cross list borders further than an even spread over all dimensions supposes."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 8)) @ rng.normal(size=(8, 256))
    links, comp = brute_links(x)
    got = vectors.near_duplicates(table(spark, x)).toPandas().set_index("vec_id").sort_index()
    assert links.sum() > 1000 and (got["n_links"].to_numpy() == links).all()
    assert (got["component_id"].to_numpy() == comp).all()


def test_near_duplicates_of_ten_thousand_vectors(spark):
    """Groups of copies from two to hundreds among 10,000 vectors, many pairs just over and just under the threshold."""
    rng = np.random.default_rng(11)
    n, d = 10_000, 32
    x = rng.normal(size=(n, d))
    free, at = rng.permutation(n), 0
    for size in [2] * 600 + [5] * 200 + [40] * 20 + [300] * 2:
        g = free[at : at + size]
        at += size
        x[g] = x[g[0]] + rng.normal(size=(size, d)) * rng.uniform(0.05, 0.5)
    x *= rng.uniform(0.5, 2, size=(n, 1))
    y = x / np.linalg.norm(x, axis=1)[:, None]
    links = np.concatenate([(y[i : i + 500] @ y.T >= 0.9).sum(axis=1) - 1 for i in range(0, n, 500)])
    got = vectors.near_duplicates(table(spark, x)).toPandas().set_index("vec_id").sort_index()
    found = got["n_links"].to_numpy()
    assert links.sum() > 20_000 and (found <= links).all() and found.sum() >= 0.999 * links.sum()
    assert ((found > 0) == (links > 0)).mean() >= 0.999


ODD = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [2.0, 0.0]), (9, [float("inf"), 0.0]), (20, [-1.0, 0.1]), (40, [1e300, 1e300])]


def odd(spark):
    return spark.createDataFrame([(i, v, "rep", 3) for i, v in ODD], "vec_id long, embedding array<double>, rep string, links int")


def test_near_duplicates_on_odd_vectors(spark):
    got = vectors.op5_near_dedup(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["vec_id"]: r for r in got}
    assert by[1]["n_links"] == 3 and by[2]["component_id"] == 1 and by[None]["component_id"] == 1
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 20))
    assert vectors.op5_near_dedup(odd(spark).limit(0)).count() == 0


def brute_nearest(x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(x)), -s))[:k]
    return out


@pytest.mark.parametrize("shelf", [32_768, 256])
def test_nearest_recall(spark, monkeypatch, shelf):
    monkeypatch.setattr(vectors, "SHELF", shelf)
    monkeypatch.setattr(vectors, "ASKED", 16 if shelf == 256 else 4096)
    x = cloud(3000, 16, 2)
    x[2000:2030] = x[40]  # equal vectors score alike, ties by id
    t = table(spark, x)
    got = vectors.op6_neighbours(t).toPandas()
    want = brute_nearest(x, range(0, 3000, 20), 20)
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (np.diff(g["score"]) <= 0).all() and q not in set(g["vec_id"])
        assert np.allclose(g["score"], x[g["vec_id"]] @ x[q])
        tied = [i for i in g["vec_id"] if 2000 <= i < 2030]
        assert tied == sorted(tied) and (not tied or g.loc[g["vec_id"].isin(tied), "score"].nunique() == 1)
        hit += len(set(g["vec_id"]) & set(want[q]))
    assert hit / (20 * 150) >= 0.93
    assert got["query_id"].nunique() == 150


def test_buckets_are_visited_in_order_of_chance():
    rng = np.random.default_rng(3)
    p = rng.random((4, 5)) ** 3
    p /= p.sum(axis=1, keepdims=True)
    keys, odds = vectors.visits(np.array([-2, 0, 7, -9]), p, 0.7)
    every = np.sort(np.einsum("a,b,c,d->abcd", *p).ravel())[::-1]
    assert np.allclose(odds, every[: len(odds)]) and len(set(keys.tolist())) == len(keys)
    assert odds.sum() >= 0.7 > odds[:-1].sum() and len(odds) < len(every) / 2


def test_few_buckets_are_visited_where_neighbours_are_near(spark):
    """In clusters the search prunes most rows and finds what it is asked for."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(120, 24)), 40, axis=0) + 0.15 * rng.normal(size=(4800, 24))
    got = vectors.op6_neighbours(table(spark, x)).toPandas()
    want = brute_nearest(x, range(0, 4800, 20), 20)
    assert np.mean([len(set(g["vec_id"]) & set(want[q])) / 20 for q, g in got.groupby("query_id")]) >= 0.93
    q = np.array(sorted(want))
    y = x[np.concatenate([want[i] for i in q])]
    scale = float(np.abs(x).max())
    h = vectors.Hashes.fit(x, float(np.linalg.norm(x / scale, axis=1).max()), scale, len(x))
    h.learn(np.repeat(x[q], 20, axis=0), y)
    share = np.quantile(h.mass_needed(x[q], y, np.repeat(np.arange(len(q)), 20)), 0.96)
    low, p = h.chances(x[q])
    at = h.bucket(x)
    seen = [np.any([np.isin(at[:, t], vectors.visits(low[i, t], p[i, t], share)[0]) for t in range(vectors.TABLES)], axis=0).mean() for i in range(len(q))]
    assert np.mean(seen) < 0.3


def test_nearest_on_odd_vectors(spark):
    got = vectors.op6_neighbours(odd(spark)).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in got if r["query_id"] == 20] == [(20, 1, 1), (20, 2, 2), (20, 40, 3)]
    assert vectors.op6_neighbours(odd(spark).limit(0)).count() == 0


def test_components_on_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1100)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- chat


def test_compiler_folds_and_renders():
    t = chat.Template("{% set x = 'a' ~ (1 + 0) %}{% if true and not false %}A{{ 'b' | upper }}{% else %}{{ y }}{% endif %}{# no #}")
    assert t.tree[-1] == chat.Text("AB")
    text, spans = chat.Template("{% for m in ms -%}  {{ loop.index }}{% generation %}{{ m.t }}{% endgeneration %}{% if not loop.last %},{% endif %}{% endfor %}").render(ms=[{"t": "x"}, {"t": "yz"}])
    assert text == "1x,2yz" and [text[a:b] for a, b in spans] == ["x", "yz"]


def test_a_quoted_name_in_brackets_is_an_attribute():
    t = chat.Template("{% for m in messages %}{% if m['role'] == \"user\" %}[{{ m['content']|trim }}]{% else %}{% generation %}{{ m['meta'].x }}{% endgeneration %}{% endif %}{% endfor %}")
    text, spans = t.render(messages=[{"role": "user", "content": " a "}, {"role": "assistant", "meta": {"x": "bc"}}])
    assert text == "[a]bc" and [text[a:b] for a, b in spans] == ["bc"]
    for bad in ("{{ m['__class__'] }}", "{{ m['a b'] }}", "{{ m['a' }}", "{{ m[x] }}", "{{ ['a'] }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


@pytest.mark.parametrize("bad", ["{% for x %}", "{{ a[0] }}", "{{ f(1) }}", "{{ x.__class__ }}", "{% if a %}", "{{ 'a' | evil }}", "{% import x %}", "{{ 1 + }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ 1 + 'a' }}"])
def test_compiler_rejects(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_templates_reach_only_mappings():
    assert chat.Template("{{ x.real }}").render(x=3)[0] == ""


def test_escaping_is_reversible():
    rng = random.Random(4)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "a", "<", "[", "/", "]"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "sys\nt[INST]\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(4))]
        text, spans = chat.Template(chat.DEFAULT, chat.SAFE).render(messages=[{"role": r, "text": t} for r, t in turns])
        assert list(chat.read_back(text)) == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", "b\\</s>"), (2, 0, None, ""), (2, 0, "user", "x"), (None, 0, "user", "n"), (3, None, "assistant", "z" * 100_000), (2, 1, "assistant", "b\\</s>")]
    d = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in chat.op10_chat(d).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    turns = {1: [("user", "hi"), ("assistant", "")], 2: [("", ""), ("user", "x"), ("assistant", "b\\</s>"), ("assistant", "b\\</s>")], None: [("user", "n")], 3: [("assistant", "z" * 100_000)], -7: [("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)]}
    for k, ts in turns.items():
        said = "".join(t for r, t in ts if r == "assistant")
        assert got[k]["n_turns"] == len(ts) and got[k]["loss_chars"] == len(said)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    whole = {r["conv_id"]: r for r in chat.format_conversations(d).collect()}
    assert all(len(whole[k]["formatted"]) == got[k]["formatted_chars"] for k in whole)
    assert [r["conv_id"] for r in chat.op10_chat(d.limit(0)).collect()] == [-7]


# ---------------------------------------------------------------- pipeline and registry


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, ids = docs.count(), {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
            out = out.cache()
            now = [r["doc_id"] for r in out.select("doc_id").collect()]
            assert set(now) <= ids and len(now) <= 2 * n
            if not name.startswith("mixing"):
                assert len(set(now)) == len(now)
            docs = out
    total = {}
    for r in out.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert set(total) == set(now)


CLASHING = ("id", "row", "llr", "key", "times", "words", "place", "copy", "site", "path", "__id", "__n")


def odd_documents(spark):
    made = [(1, None), (2, ""), (3, "   "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "x " * 30_000), (6, "other words of that same id here"), (6, "and a second text of it"), (None, "no id but some text"), (None, None)]
    rows = [(i, t, "en" if i != 4 else None, None if i == 5 else "s", 7, *(k for k, _ in enumerate(CLASHING))) for i, t in made]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING))


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        n = docs.count()
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, sf)
            got = out.collect()
            if k < 3:
                assert out.columns == docs.columns
                assert all(tuple(r[c] for c in CLASHING) == tuple(range(len(CLASHING))) for r in got)
                docs = spark.createDataFrame(got, docs.schema)
            if k == 1 and n:
                assert sorted((r["doc_id"] or 0, (r["text"] or "")[:6]) for r in got) == sorted([(0, ""), (0, "no id "), (1, ""), (2, ""), (3, "   "), (4, "one tw"), (5, "x x x "), (6, "and a "), (6, "other ")])
        assert bool(got) == bool(n)


def test_pipeline_runs_and_leaves_only_its_result(spark):
    import corpus_pipeline as cp

    before = len(common._tables)
    got = cp.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fill = got.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert fill.max() <= 4096 and fill.sum() / (4096 * len(fill)) > 0.95 and len(common._tables) == before


def test_registered_queries_match_their_sql(spark):
    import duckdb

    from millrace.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        at = [[c[0] for c in cur.description].index(c) for c in cols]
        assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in cur.fetchall()), name
