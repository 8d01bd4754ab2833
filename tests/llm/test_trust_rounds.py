"""Trust and distrust along chains that are longer than any fixed number of rounds."""

from attestor.llm import url_trust


def converged(edges, t0, d0):
    out, into = {}, {}
    for s, e, n in edges:
        out[s], into[e] = out.get(s, 0) + n, into.get(e, 0) + n
    t, d = {}, {}
    for _ in range(400):
        nt, nd = ({h: 0.15 * v for h, v in x.items()} for x in (t0, d0))
        for s, e, n in edges:
            nt[e] = nt.get(e, 0) + 0.85 * t.get(s, 0) * n / out[s]
            nd[s] = nd.get(s, 0) + 0.85 * d.get(e, 0) * n / into[e]
        t, d = nt, nd
    return t, d


def test_long_chain_and_near_tie(spark):
    # h0 -> h1 -> ... -> h21 -> bad: distrust reaches h0 in 22 rounds, just above its trust.
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(21)] + [("h21", "bad", 1), ("good", "h0", 275), ("good", "other", 9725)]
    seeds = [("good", True, False), ("bad", False, True)]
    t, d = converged(edges, {"good": 1.0}, {"bad": 1.0})
    assert t["h0"] < d["h0"] < 1.25 * t["h0"]
    got = url_trust.propagate(
        spark.createDataFrame(edges, "src string, dst string, n bigint"),
        spark.createDataFrame(seeds, "host string, trusted boolean, blocked boolean"),
    ).collect()
    assert {r.host for r in got} == set(t) | set(d)
    for r in got:
        assert abs(r.trust - t.get(r.host, 0)) < 1e-6 and abs(r.distrust - d.get(r.host, 0)) < 1e-6


def test_rounds_follow_from_damping_and_tolerance():
    rounds = url_trust.enough_rounds()
    assert 4 * 0.85 ** (rounds - 2) <= 1e-6 < 4 * 0.85 ** (rounds - 4)
