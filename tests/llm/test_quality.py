"""Base counts and verdicts against plain Python."""

import random
from collections import Counter, defaultdict

from ixlake.llm.quality import clean_documents, judge_documents


def words(text):
    return (text or "").encode().split()


def base(text):
    text = text or ""
    own = words(text)
    found = defaultdict(list)
    for i in range(len(own) - 7):
        found[tuple(own[i : i + 8])].append(i)
    covered = {i + k for at in found.values() if len(at) > 1 for i in at for k in range(8)}
    lines, seen, duplicates = text.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            duplicates += line in seen
            seen.add(line)
    n = len(own)
    return {
        "n_words": n,
        "word_chars": sum(len(w.decode()) for w in own),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": duplicates,
        "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def line(text):
    return b" ".join(text.encode().lower().split())


def brute(rows):
    by_host = defaultdict(set)
    for _, text, host in rows:
        by_host[host].add(text or "")
    frequent = {}
    for host, texts in by_host.items():
        counts = Counter(x for t in texts for x in {line(y) for y in t.split("\n")} if x)
        frequent[host] = {x for x, n in counts.items() if n > 10 and n * 100 > len(texts)}
    out = {}
    for i, text, host in rows:
        measured = base(text)
        gone = sum(len(x.split()) for x in map(line, (text or "").split("\n")) if x in frequent[host])
        left = measured["n_words"] - gone
        kept = not measured["base_failed"] and left >= 20 and left * 100 >= 30 * measured["n_words"]
        cleaned = "\n".join(x for x in (text or "").split("\n") if line(x) not in frequent[host])
        out[i] = (measured | {"kept": kept}, cleaned if kept else None)
    return out


def test_measures_and_verdicts(make_docs, all_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in all_docs.collect()]
    rng = random.Random(1)
    foot = "Share  this page with all of your friends and subscribe now " * 3
    for i in range(60):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 40])))
        rows.append((10_000 + i, f"{own}\n{foot.upper() if i % 2 else foot}", "h" if i % 3 else None))
    rows += [(20_000 + i, "copy of one text " * 2 + " ".join(f"c{k}" for k in range(30)), "h") for i in range(30)]
    rows += [(30_000, None, "h"), (30_001, "", None), (30_002, " \t\n\x0b", "h"), (30_003, "é<>|# " * 40, "h"), (30_004, "z" * 200_000, "h")]
    expected = brute(rows)
    docs = make_docs(rows)
    out = {r["doc_id"]: r.asDict() for r in judge_documents(docs).collect()}
    assert out.keys() == expected.keys()
    for i, (wanted, _) in expected.items():
        assert {k: out[i][k] for k in wanted} == wanted
    cleaned = clean_documents(docs)
    assert cleaned.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {i: t for i, (_, t) in expected.items() if t is not None}
    assert all(out[20_000 + i]["kept"] for i in range(30))


def test_edges(make_docs):
    assert judge_documents(make_docs([])).count() == 0 and clean_documents(make_docs([])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(None, text, None), (None, text, None), (1, text), (1, text)]).selectExpr("*", "1 AS lines", "2 AS frequent")
    assert [r["kept"] for r in judge_documents(docs).collect()] == [True] * 4
    assert clean_documents(docs).count() == 4
