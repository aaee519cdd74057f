"""The conversation trie, the Merkle manifest and link trust: against brute force on small adversarial tables and against SQL on whole ones; edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from wardenlake.llm import link_trust, merkle_manifest, prefix_trie, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest", "op13_link_trust"])
def test_against_sql(spark, name):
    oracle.compare(spark, oracle.connect(FOLDER), queries.QUERIES[name], queries.SQL[name], FOLDER)


# --- conversations ---------------------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, depth int, pid int, base string"


def trie_brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(str(c) for c in sorted(m) if seqs[c] == p) for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()
    )


def trie_rows(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "b") for r in rows], CONVERSATIONS)


@pytest.mark.parametrize(("seed", "tasks"), [(1, 1), (2, 7), (3, 40)])
def test_trie_over_many_borders(spark, seed, tasks):
    """Few different turns, so that paths are shared over borders, prefixes end inside others and copies fill several tasks."""
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        fill = "ab" if c % 3 else "a"
        rows += [(c * (1 if c % 7 else 3), t, "user", rng.choice(fill) * rng.choice((1, 1, 1, 3))) for t in range(rng.choice((0, 1, 2, 4, 12)))]
    assert trie_rows(prefix_trie.trie(conversations(spark, rows), tasks)) == trie_brute(rows)


def test_trie_of_one_group_of_copies(spark):
    """All conversations are the same: one path, whose ends are hashed over all tasks."""
    rows = [(c, t, "user", f"t{t}") for c in range(400) for t in range(9)]
    got = trie_rows(prefix_trie.trie(conversations(spark, rows), 16))
    assert got == trie_brute(rows) and len(got) == 10
    assert max(r[3] for r in got) == 400


def test_trie_edges(spark):
    rows = [
        (0, None, None, None), (0, 0, "user", "x"), (0, 0, "user", "x"), (0, None, "user", ""), (1, 3, "user", "y" * 100_000), (1, 2, None, "é"), (2, 1, "user", None), (None, 1, "user", "lost"),
        (7, 0, "a", "b"), (12, 0, "ab", ""), (13, 5, "", "ab"), (25, 1, "user", "x"),
    ]
    for tasks in (1, 5):
        assert trie_rows(prefix_trie.trie(conversations(spark, rows), tasks)) == trie_brute(rows)
    assert prefix_trie.trie(conversations(spark, rows).limit(0)).count() == 0
    assert prefix_trie.trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0


def test_trie_of_a_long_conversation(spark):
    rows = [(c, t, "user", f"{t % 3}") for c in (0, 1, 2) for t in range(3000 if c else 2500)]
    assert trie_rows(prefix_trie.trie(conversations(spark, rows), 3)) == trie_brute(rows)


# --- manifest ----------------------------------------------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, grp string, level int, node string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb_brute(nodes):
    """The root and each node's siblings with their sides (null: alone)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            paths[i].append((nodes[a ^ 1] if a ^ 1 < len(nodes) else None, a % 2 == 1))
        nodes, at = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [a // 2 for a in at]
    return nodes[0], paths


def manifest_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: climb_brute([x[2] for x in sorted(groups[g])]) for g in langs}
    root, above = climb_brute([built[g][0] for g in langs])
    out = []
    for g, over in zip(langs, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[g]), built[g][1], strict=True):
            doc_id, text, lang, source, n = r
            bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            h = leaf_of(doc_id, text, lang, source, n + 1) if bad else leaf
            for sibling, before in path + over:
                h = sha(sibling, h) if before else sha(h, sibling or "")
            out.append((-1 if doc_id is None else doc_id, leaf, built[g][0], root, sha(*(s for s, _ in path + over if s)), h, not bad))
    return sorted(out)


def manifest_rows(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def documents(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "n", "p") for r in rows], DOCUMENTS)


@pytest.mark.parametrize(("tasks", "width"), [(1, 20), (5, 20), (23, 2), (9, 3)])
def test_manifest_over_many_borders(spark, tasks, width):
    """Groups of one to hundreds of leaves, stretches that cut them anywhere, and blocks so narrow that several rounds finish the tree."""
    rng = random.Random(tasks)
    rows = [(i, f"text {i}", rng.choice(("en", "en", "en", "de", None, "é")), rng.choice(("s", None)), rng.choice((None, 5, 7))) for i in rng.sample(range(5000), 333)] + [(9999, "alone", "zz", "s", 1)]
    assert manifest_rows(merkle_manifest.manifest(documents(spark, rows), tasks, width)) == manifest_brute(rows)


def test_manifest_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (2, "", "en", "", 0), (2, "other", "en", "", 0), (None, "x", "en", "s", 1), (None, None, "", None, None), (-4, "y" * 200_000, "en", "s", 200_000), (7, "1:2", "1:", "-", 3)]
    for tasks in (1, 4):
        assert manifest_rows(merkle_manifest.manifest(documents(spark, rows), tasks)) == manifest_brute(rows)
    assert merkle_manifest.manifest(documents(spark, rows).limit(0)).count() == 0
    [one] = merkle_manifest.manifest(documents(spark, rows[1:2])).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")


def test_manifest_of_one_hot_key(spark):
    """Rows that share their key and even all columns are leaves each."""
    rows = [(5, "same", "en", "s", 4)] * 300 + [(i, f"t{i}", "en", "s", 2) for i in range(100)]
    assert manifest_rows(merkle_manifest.manifest(documents(spark, rows), 11, 4)) == manifest_brute(rows)


def test_manifest_of_many_groups(spark):
    rows = [(i, "t", f"lang{i % 97}", "s", i) for i in range(300)]
    assert manifest_rows(merkle_manifest.manifest(documents(spark, rows), 6, 3)) == manifest_brute(rows)


# --- link trust -------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, rule string, trust string, w int, kind string"


def link(*hosts):
    return " ".join(f'<a class=x href="{h}/p?q#f">t</a>' for h in hosts)


def trust_brute(pages, rounds=link_trust.ROUNDS):
    """The same walk with dictionaries. Pages: (host, targets)."""
    edges = defaultdict(int)
    names = set()
    for host, targets in pages:
        for t in {t for t in targets if t != host and host}:
            edges[host, t] += 1
            names.add(t)
        names.add(host)
    up = set()
    for name in names:
        labels = name.split(".")
        for i in range(len(labels) - 2):
            up.add((".".join(labels[i:]), ".".join(labels[i + 1 :])))
    for a, b in up:
        edges[a, b] += 1
        edges[b, a] += 1
    return edges


def walk(edges, seeds, back, rounds=link_trust.ROUNDS):
    flow = defaultdict(list)
    for (a, b), w in edges.items():
        flow[b if back else a].append((a if back else b, w))
    unit = link_trust.MASS // sum(seeds.values()) if seeds else 0
    start = {h: n * unit for h, n in seeds.items()}
    ranks = dict(start)
    for _ in range(rounds):
        after = defaultdict(int, {h: m * (100 - link_trust.DAMPING) // 100 for h, m in start.items()})
        for h, m in ranks.items():
            m, total = m * link_trust.DAMPING // 100, sum(w for _, w in flow[h])
            for to, w in flow[h]:
                after[to] += m // total * w + m % total * w // total
        ranks = after
    return ranks


GRAPH = [  # url, targets
    ("https://good.example.org/en/2", ["friend.test", "neutral.test"]), ("https://good.example.org/en/3", ["friend.test"]), ("http://friend.test/x", ["second.test"]),
    ("http://farm1.test/a", ["bad.com", "farm2.test"]), ("http://farm2.test/a", ["farm1.test", "bad.com"]), ("http://bad.com/de/1", ["bad.com"]), ("http://bad.com/other", []),
    ("http://second.test/", []), ("http://neutral.test", ["bad.com", "farm1.test", "friend.test"]), ("http://deep.sub.farm1.test/z", []), ("http://island.test/z", []),
    ("HTTP://Good.Example.ORG/es/1", []), ("http://example.org/en/12", []), ("http://notexample.org/en/12", []), ("http://x.com/fr", []), ("http://x.com?/fr", []), (None, ["friend.test"]), ("no scheme", ["bad.com"]), ("http:///fr", []),
]


def pages(spark, graph):
    return spark.createDataFrame([(i, u, link(*(f"https://{t}" for t in targets)) if targets else None, "h", "r", "t", 1, "k") for i, (u, targets) in enumerate(graph)], PAGES)


@pytest.mark.parametrize("small_rows", [link_trust.SMALL_ROWS, 0])
def test_trust_by_brute_force(spark, small_rows):
    got = {r["page_id"]: r for r in link_trust.verdicts(pages(spark, GRAPH), small_rows=small_rows).collect()}
    assert len(got) == len(GRAPH)
    hosts = [got[i]["host"] for i in range(len(GRAPH))]
    edges = trust_brute([(hosts[i], t) for i, (_, t) in enumerate(GRAPH)])
    seeds = {"allow": defaultdict(int), "block": defaultdict(int)}
    for r in got.values():
        if r["rule"] is not None:
            seeds[r["verdict"]][r["host"]] += 1
    trust, distrust = walk(edges, seeds["allow"], False), walk(edges, seeds["block"], True)
    for r in got.values():
        assert (r["trust"], r["distrust"]) == (trust.get(r["host"], 0), distrust.get(r["host"], 0)), r
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["distrust"] > r["trust"] else "allow")
    by = {u: got[i] for i, (u, _) in enumerate(GRAPH)}
    assert by["http://farm1.test/a"]["verdict"] == by["http://farm2.test/a"]["verdict"] == by["http://deep.sub.farm1.test/z"]["verdict"] == "block"
    assert by["http://friend.test/x"]["verdict"] == by["http://second.test/"]["verdict"] == by["http://island.test/z"]["verdict"] == "allow"
    assert by["http://second.test/"]["trust"] > 0 == by["http://island.test/z"]["trust"]


def test_trust_rules(spark):
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in link_trust.verdicts(pages(spark, GRAPH)).collect()}
    assert by[11] == ("good.example.org", "/es/1", "example.org/es/", "block")
    assert by[12] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[13] == ("notexample.org", "/en/12", "org/", "allow")
    assert by[14] == ("x.com", "/fr", "com/fr", "allow")
    assert by[15][:3] == ("x.com", "", None) and by[8][:3] == ("neutral.test", "", None)
    assert by[16] == by[17] == ("", "", None, "allow") and by[18] == ("", "/fr", None, "allow")


def test_trust_query_has_the_rules_of_its_contract(spark, tmp_path):
    """com/fr/ and com/de/ end with a slash: pages beside these folders have no rule, and seed nothing."""
    graph = [("http://x.com/fr/1", []), ("http://x.com/fr", []), ("http://a.x.com/france/1", []), ("http://y.com/de/", []), ("http://z.com/de", []), ("http://z.com/demo?/de/", []), ("http://com/de/1", []), ("http://example.org/en/12", []), ("http://example.org/es/", []), ("http://example.org/es", [])]
    pages(spark, graph).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op13_link_trust(spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(len(graph))] == ["com/fr/", None, None, "com/de/", None, None, "com/de/", "example.org/en/1", "example.org/es/", "org/"]
    assert [got[i][1] for i in (0, 3, 4, 5, 6, 7, 8, 9)] == ["allow", "block", "allow", "allow", "block", "block", "block", "allow"]


def test_trust_edges(spark):
    assert link_trust.verdicts(pages(spark, GRAPH).limit(0)).count() == 0
    odd = [("http://" + "a." * 5000 + "com/q", []), ("http://1.2.3.4:80/x", []), ("://h.x.y#/p", []), ("a://b://c", []), ("http://x.com/fr\n/ü?", [])] * 2
    by = {r["page_id"]: (r["host"], r["path"]) for r in link_trust.verdicts(pages(spark, odd)).collect()}
    assert by[1] == ("1.2.3.4:80", "/x") and by[2] == ("h.x.y", "") and by[3] == ("b:", "//c") and by[4] == ("x.com", "/fr\n/ü") and by[6] == by[1]
    html = 'href = "//One.test/x" HREF=\'http://two.test\' href=three.test/ data="http://no.test" href="/local" href=https://four.test:8080 href="' + " " * 300_000 + '" ' + "href=" * 100_000
    df = spark.createDataFrame([(1, "http://me.test/", html)], "page_id long, url string, html string")
    assert {r["dst"] for r in link_trust.link_edges(df).collect()} == {"one.test", "two.test", "four.test:8080"}


def test_trust_of_a_hub(spark):
    """One host holds a third of all pages and of all edges; the joins that split off heavy keys give what the plain ones give."""
    graph = [("http://hub.test/a", [f"h{i}.test"]) for i in range(150)] + [(f"http://h{i}.test/", ["hub.test", "x.example.org"]) for i in range(150)] + [("http://x.example.org/en/9", ["hub.test"]), ("http://evil.com/de/", ["hub.test"])]
    rows = lambda small: sorted(tuple(r) for r in link_trust.verdicts(pages(spark, graph), small_rows=small).collect())
    assert rows(0) == rows(link_trust.SMALL_ROWS)
