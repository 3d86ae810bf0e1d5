import random

import pytest

from answerscope.llm import hamming_search as H
from answerscope.llm import url_filter as U
from answerscope.llm.common import Scratch

PAGES = "page_id bigint, url string, html string, host string, rank double"


def page_rank(seeds, edges, follow=0.85, steps=200):
    """Seeds by host, pushed along edges; plain loops."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rank = {h: (1 - follow) * s for h, s in seeds.items()}
    now = dict(rank)
    for _ in range(steps):
        moved = {h: (1 - follow) * s for h, s in seeds.items()}
        for a, targets in out.items():
            for b in targets:
                moved[b] = moved.get(b, 0) + follow * now.get(a, 0) / len(targets)
        now = moved
    return now


def test_propagation_against_loops(spark):
    rnd = random.Random(3)
    hosts = [f"h{k}" for k in range(30)]
    edges = {(a, b) for a in hosts for b in rnd.sample(hosts, 3) if a != b} | {(h, "hub") for h in hosts}
    seeds = {h: (rnd.choice([0.0, 0.5, 1.0]), rnd.choice([0.0, 0.0, 1.0])) for h in hosts}
    frame = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    got = {r.host: r for r in U.propagate(frame, spark.createDataFrame(sorted(edges), "src string, dst string"), Scratch(spark, "test"), steps=80).collect()}
    trust = page_rank({h: s[0] for h, s in seeds.items()}, edges)
    bad = page_rank({h: s[1] for h, s in seeds.items()}, [(b, a) for a, b in edges])
    for h in [*hosts, "hub"]:
        assert (got[h].trust if h in got else 0) == pytest.approx(trust.get(h, 0), abs=2e-3)
        assert (got[h].distrust if h in got else 0) == pytest.approx(bad.get(h, 0), abs=2e-3)


def test_pages(spark, tmp_path):
    link = lambda *hosts: "".join(f'<a HREF = "https://{h}/x?y">a</a><a href="/local">b</a>' for h in hosts)
    rows = [
        (1, "http://A.Example.COM/en/1?q#f", None, "c", 1.0), (2, "http://www.example.com/en/", "", "c", 1.0), (3, "https://x.net/es/1", "", "c", 1.0), (4, "https://x.net/de/1", "", "c", 1.0),
        (5, "https://bad.net/fr/9", "", "c", 1.0), (6, "https://friend.org/", link("bad.net", "bad.net"), "c", 1.0), (7, "https://good.org", "", "c", 1.0), (8, "https://ok.com/a", link("good.org"), "c", 1.0),
        (9, None, link("bad.net"), "c", 1.0), (10, "no-scheme.com/en/", "", "c", 1.0), (None, "http://com?x", "", "c", 1.0), (12, "http://notcom/", "", "c", 1.0), (12, "http://notcom/", "", "c", 1.0),
        (13, "http://bad.net/fr/" + "p" * 100_000, "", "c", 1.0)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    found = U.op9_url_filter(spark, str(tmp_path)).collect()
    got = {r.page_id: tuple(r)[1:] for r in found}
    assert len(found) == len(rows)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block") and got[4] == ("x.net", "/de/1", None, "allow")  # half of the host's pages
    assert got[5][3] == "block" and got[6] == ("friend.org", "/", None, "block") and got[7] == ("good.org", "", None, "allow") and got[8][2:] == ("com/", "allow")
    assert got[9] == ("", "", None, "allow") == got[10] and got[None] == ("com", "", None, "allow") and got[12] == ("notcom", "/", None, "allow")


@pytest.mark.parametrize("linkers", [2, 50])
def test_hosts_that_link_to_a_much_linked_blocked_host_only(spark, linkers):
    link = lambda *hosts: "".join(f'<a href="https://{h}/">a</a>' for h in hosts)
    rows = [(0, "https://bad.net/fr/", "", "c", 1.0)] + [(k, f"https://fan{k}.org/", link("bad.net"), "c", 1.0) for k in range(1, linkers + 1)]
    rows += [(100, "https://second.org/", link("fan1.org"), "c", 1.0), (101, "https://list.org/", link("bad.net", *(f"fine{k}.org" for k in range(9))), "c", 1.0)]
    rows += [(102, "https://ok.com/", link("bad.net"), "c", 1.0)]
    got = {r.page_id: r.verdict for r in U.judge_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[k] for k in range(linkers + 1)] == ["block"] * (linkers + 1)
    assert got[100] == "block" and got[101] == "allow" == got[102]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert U.op9_url_filter(spark, str(tmp_path)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, code string"


def brute(rows, k, every):
    codes = {}
    for vec, e, _, _ in rows:
        if vec is not None and e and None not in e:
            codes[vec] = sum(1 << i for i, x in enumerate(e[:64]) if x > 0)
    out = []
    for q in codes:
        if q % every == 0:
            near = sorted(((codes[q] ^ c).bit_count(), v) for v, c in codes.items() if v != q)[:k]
            out += [(q, v, d, n + 1) for n, (d, v) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "spread", "few"])
def test_search_against_brute_force(spark, tmp_path, kind):
    rnd = random.Random(7)
    vector = lambda: [rnd.choice([-1.0, 1.0]) for _ in range(64)]
    centres = [vector() for _ in range(4)]
    near = lambda c: [-x if rnd.random() < 0.05 else x for x in c]
    n = {"clusters": 400, "spread": 150, "few": 4}[kind]
    rows = [(k, near(rnd.choice(centres)) if kind == "clusters" else vector(), 0, "c") for k in range(n)]
    rows += [(1000 + k, centres[0], 0, "c") for k in range(120 if kind == "clusters" else 0)]
    rows += [(2000, None, 0, "c"), (2050, [], 0, "c"), (2100, [None] * 64, 0, "c"), (None, centres[0], 0, "c"), (3000, [1.0, -1.0], 0, "c"), rows[0]]
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, H.op6_hamming_topk(spark, str(tmp_path)).collect())) == brute(rows, H.K, H.EVERY)


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert H.op6_hamming_topk(spark, str(tmp_path)).count() == 0
