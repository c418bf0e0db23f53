"""Every stage of the pipeline against what it must keep and drop."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from ixlake.llm.mixing import mix_documents
from test_links import brute_lines, brute_near
from test_quality import brute


def corpus():
    rng = random.Random(8)

    def prose(n, seed=None):
        own = rng if seed is None else random.Random(seed)
        return " ".join("".join(own.choice("abcdefghij") for _ in range(own.randint(3, 8))) for _ in range(n))

    rows = []
    for i in range(120):
        rows.append((i, "\n".join(prose(rng.randint(12, 25)) for _ in range(4)), rng.choice(["a", "b", "c", None])))
    base = [prose(60, 77) for _ in range(1)][0].split(" ")
    for i in range(15):
        own = list(base)
        own[i] = f"edit{i}"
        rows.append((200 + i, " ".join(own), "a"))
    rows += [(300 + i, rows[3][1], "b") for i in range(10)]
    rows += [(400, None, "a"), (401, "", "b"), (402, "too short", "c"), (403, "word " * 200, "a")]
    return rows


def test_stages(spark, make_docs, tmp_path):
    rows = corpus()
    docs = make_docs(rows)
    columns = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        got[name] = docs.collect()
        if name != "packed":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in got[name])
    # Quality.
    expected = {i: text for i, (_, text) in brute(rows).items() if text is not None}
    assert {r["doc_id"]: r["text"] for r in got["quality"]} == expected
    # Lines: what remains of each, without documents that lost everything.
    remaining = brute_lines(list(expected.items()))
    remaining = {i: t for i, t in remaining.items() if t == expected[i] or t.split()}
    assert {r["doc_id"]: r["text"] for r in got["lines"]} == remaining
    # Near copies: the least of each group.
    groups = brute_near(list(remaining.items()), 5, 80)
    assert sorted(r["doc_id"] for r in got["near_copies"]) == sorted(i for i, (_, first) in groups.items() if first == i)
    # Mixture: whole documents, as often as the operator takes them.
    mix = {r["doc_id"]: r["taken"] // r["size"] for r in mix_documents(spark.read.parquet(str(tmp_path / "near_copies"))).collect()}
    assert Counter(r["doc_id"] for r in got["mixture"]) == Counter({i: n for i, n in mix.items() if n})
    # Packing: every id of every row in one piece.
    tokens, total = defaultdict(int), Counter()
    for r in got["packed"]:
        tokens[r["doc_id"]] += r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert all(tokens[i] == total[i] * mix[i] for i in total) and set(total) == {i for i, n in mix.items() if n}
    assert before.count() == len(got["mixture"])


def test_run_on_a_given_folder(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("length > 0").count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixture", "packed"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables(spark, make_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), "").count() == 0, name


def test_mixture_of_rows_that_share_id_and_size(spark, make_docs):
    def mixed(ids):
        rows = [(ids(i), f"one two three w{i}", "c") for i in range(60)]
        rows += [(1000 + i, f"one two w{i}", s) for s, n in (("a", 40), ("b", 40)) for i in range(n)]
        got = corpus_pipeline.mixture(spark, make_docs(rows), "").collect()
        return Counter((r["source"], r["text"]) for r in got)

    unique, nulls, repeated = mixed(lambda i: i), mixed(lambda i: None), mixed(lambda i: i // 30)
    words = lambda got, s: sum(n * len(t.split()) for (x, t), n in got.items() if x == s)
    assert 0 < sum(n for (s, _), n in unique.items() if s == "c") < 60
    for got in (nulls, repeated):
        assert all(words(got, s) == words(unique, s) for s in "abc")
    assert max(n for (s, _), n in nulls.items() if s == "c") == 1


def test_near_copies_keep_one_row_a_group(spark, make_docs):
    def family(name):
        base = [f"{name}{i}" for i in range(80)]
        return [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (0, 1, 78)] + [" ".join(base)]

    a, b, c, d = map(family, "abcd")
    rows = [(None, t) for t in a]  # a group without ids
    rows += [(1, b[0]), (None, b[1]), (None, b[2])]  # its copies have the id of a row that stays
    rows += [(2, c[0]), (5, c[1]), (5, "another text " * 9)]  # 5 stays for its other text only
    rows += [(7, d[0]), (7, d[1]), (7, d[0].upper()), (7, d[0])]  # one id on several texts of a group
    rows += [(None, None), (8, ""), (8, " ")]
    got = corpus_pipeline.near_copies(spark, make_docs(rows), "").collect()
    kept = Counter((r["doc_id"], r["text"]) for r in got)
    assert set(kept.values()) == {1}
    groups = {name: [k for k in kept if k[1] in set(texts) | {t.upper() for t in texts}] for name, texts in zip("abcd", (a, b, c, d))}
    assert [len(groups[n]) for n in "abcd"] == [1] * 4
    assert groups["b"] == [(1, b[0])] and groups["c"] == [(2, c[0])] and groups["d"][0][0] == 7
    rest = set(kept) - {k for ks in groups.values() for k in ks}
    assert rest == {(5, "another text " * 9), (None, None), (8, ""), (8, " ")}


def test_mixture_writes_no_texts_before_they_meet_their_copies(spark, make_docs, monkeypatch):
    written = []
    keep = corpus_pipeline.saved
    monkeypatch.setattr(corpus_pipeline, "saved", lambda df, name="step": written.append(df.columns) or keep(df, name))
    docs = make_docs([(1, "one two three", "a"), (1, "one two three", "a"), (2, "four five", None), (None, "six", "b")])
    # Equal but for the column that is null.
    docs = docs.unionByName(docs.where("doc_id = 2").selectExpr("doc_id", "text", "source AS lang", "lang AS source", "n_chars"))
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    assert written and not any("text" in columns for columns in written)
    rows = Counter(docs.collect())
    expected = mix_documents(docs.selectExpr("*", "monotonically_increasing_id() AS row"), row="row").where("taken > 0")
    total = expected.selectExpr("sum(taken DIV size)").first()[0]
    assert len(got) == total
    assert set(got) <= set(rows) and all(n <= 3 * rows[r] for r, n in Counter(got).items())
