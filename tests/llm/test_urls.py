import pytest

from plumbline.llm import urls


@pytest.fixture
def judged(spark):
    def run(pages, labels, **options):
        p = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, host string, n int")
        return urls.judge(p, spark.createDataFrame(labels, "page_id long, good boolean"), **options)

    return run


def test_hosts_paths_and_rules(judged):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/x": ("", "", None, "allow"),
        "http://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12#x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "x://É.com/fr/a://b": ("É.com", "/fr/a://b", "com/fr/", "allow"),
        "http://com/de/": ("com", "/de/", "com/de/", "block"),
        "http://org": ("org", "", None, "allow"),
        "http://a.com?/de/": ("a.com", "", None, "allow"),
        "http://ex.com/a\nb": ("ex.com", "/a\nb", None, "allow"),
    }
    found = {r["page_id"]: r for r in judged(list(enumerate(cases)), []).collect()}
    for i, (url, want) in enumerate(cases.items()):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == want, url


def test_impure_templates_are_rejected(judged):
    pages = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(200)] + [(300 + i, f"http://g.net/item/{i}") for i in range(20)]
    labels = [(i, i % 2 == 0) for i in range(160)] + [(None, True), (5, None), (9999, False)]
    found = {r["page_id"]: r for r in judged(pages, labels).collect()}
    assert {found[i]["template"] for i in range(200)} == {"/news/{num}.html", "/spam/{num}.html"}
    assert all(found[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(200))
    assert found[300]["template"] == "/item/{num}" and found[300]["labelled"] == 0


def test_alike_branches_merge_and_rare_ones_become_wildcards(judged):
    pages = [(i, f"http://h.net/{'abc'[i % 3]}/x{i % 2}") for i in range(300)] + [(1000 + i, f"http://m.net/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/page") for i in range(300)]
    labels = [(i, (i // 6) % 4 != 0) for i in range(300)]
    found = {r["page_id"]: r for r in judged(pages, labels).collect()}
    assert {found[i]["template"] for i in range(300)} == {"/{a|b|c}/{x0|x1}"}
    assert {found[1000 + i]["template"] for i in range(300)} == {"/{*}/page"}


def test_labels_keep_rare_and_deep_branches_apart(judged):
    def name(i):
        return "sec-" + chr(97 + i % 26) + chr(97 + i // 26)

    pages = [(i, f"http://h.net/{name(i // 20)}/p") for i in range(6000)] + [(10_000 + i, f"http://h.net/spam/{name(i)}") for i in range(40)]
    pages += [(20_000 + i, f"http://d.net/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/g/h/x") for i in range(100)]
    labels = [(i, True) for i in range(0, 6000, 4)] + [(10_000 + i, False) for i in range(40)] + [(20_000 + i, i % 2 == 0) for i in range(100)]
    found = {r["page_id"]: r for r in judged(pages, labels).collect()}
    assert {found[i]["template"] for i in range(6000)} == {"/{*}/p"} and {found[i]["verdict"] for i in range(6000)} == {"allow"}
    assert {found[10_000 + i]["verdict"] for i in range(40)} == {"block"}
    assert {found[20_000 + i]["template"] for i in range(100)} == {f"/a/b/c/d/e/f/{k}/g/h/x" for k in ("news", "spam")}
    assert all(found[20_000 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(100))


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/a/1/2024-01-05/deadbeef1/x.HTML", ["a", "{num}", "{date}", "{hex}", "x.HTML"]),
        ("//a///12.html/", ["a", "{num}.html"]),
        ("/{x}|y", ["(x)!y"]),
        ("/a/b/c/d/e/f/g/h", ["a", "b", "c", "d", "e", "f", "{rest}"]),
        ("/123e4567-e89b-12d3-a456-426614174000", ["{uuid}"]),
        ("/post123x/" + "y" * 50, ["{mixed}", "{long}"]),
        ("", []),
    ],
)
def test_segments(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(urls.segments(urls.F.col("p"))).first()[0] == want


def test_repeated_rows_and_empty(judged):
    assert judged([(1, "http://a.net/x")] * 3 + [(None, "http://a.net/x")], [(1, True)]).count() == 4
    assert judged([], []).count() == 0


def test_no_chain_of_small_steps(judged):
    """Sections whose shares of good pages rise from none to all are not one template: the ends differ, and the bad sections are blocked."""
    pages = [(i, f"http://h.net/sec{chr(97 + i // 40)}/p{i}") for i in range(440)]
    labels = [(i, i % 40 < 4 * (i // 40)) for i in range(440)]
    found = {r["page_id"]: r for r in judged(pages, labels).collect()}
    assert {found[i]["verdict"] for i in range(40)} == {"block"} and {found[i]["verdict"] for i in range(400, 440)} == {"allow"}
    assert found[0]["template"].split("/")[1] != found[439]["template"].split("/")[1]


def by_hand(paths, overall):
    """Templates of labelled paths (segments, good, bad), node by node."""
    out = {}

    def apart(x, y):
        (g1, b1), (g2, b2) = x, y
        n1, n2 = g1 + b1, g2 + b2
        return (g1 * n2 - g2 * n1) ** 2 * (n1 + n2) > urls.APART * n1 * n2 * (g1 + g2) * (b1 + b2)

    def node(rows, template):
        for s, whole, g, b in rows:
            if not s:
                out[whole] = template
        rows = [r for r in rows if r[0]]
        sums = {}
        for s, _, g, b in rows:
            old = sums.get(s[0], (0, 0))
            sums[s[0]] = old[0] + g, old[1] + b
        groups = []
        for _, name in sorted(((g + urls.WEIGHT * overall) / (g + b + urls.WEIGHT), k) for k, (g, b) in sums.items() if not k.startswith("{")):
            x = sums[name]
            if groups and not apart(x, tuple(map(sum, zip(*[sums[n] for n in groups[-1]], strict=True)))) and not apart(x, next((sums[n] for n in groups[-1] if sum(sums[n])), (0, 0))):
                groups[-1].append(name)
            else:
                groups.append([name])
        groups += [[k] for k in sums if k.startswith("{")]
        for names in groups:
            token = names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
            node([(s[1:], whole, g, b) for s, whole, g, b in rows if s[0] in names], f"{template}/{token}")

    node([(s, s, g, b) for s, g, b in paths], "")
    return out


def test_against_a_plain_tree(judged):
    import random

    rng = random.Random(4)
    paths = [tuple(rng.choice("abcde") * 2 for _ in range(rng.randrange(6))) for _ in range(500)]
    labels = [(i, rng.random() < {"aa": 0.1, "bb": 0.15, "cc": 0.5}.get((p or ("x",))[0], 0.9)) for i, p in enumerate(paths) if rng.random() < 0.8]
    found = {r["page_id"]: r["template"] for r in judged([(i, "http://h.net/" + "/".join(p)) for i, p in enumerate(paths)], labels).collect()}
    votes = dict(labels)
    counts = {}
    for i, p in enumerate(paths):
        g, b = counts.get(p, (0, 0))
        counts[p] = (g + votes[i], b + 1 - votes[i]) if i in votes else (g, b)
    good = sum(g for g, _ in counts.values())
    bad = sum(b for _, b in counts.values())
    want = by_hand([(p, g, b) for p, (g, b) in counts.items()], (good + 1.0) / (good + bad + 2.0))
    assert {i: found[i] for i in found} == {i: want[p] for i, p in enumerate(paths)}


def test_deep_paths(judged):
    """Rounds do not follow the length of a path: one URL of 5,000 segments, and 300 that are each the begin of the next."""
    import time

    start = time.time()
    found, = judged([(1, "http://h.net/" + "/".join(f"s{'abc'[i % 3]}" for i in range(5000)))], [(1, True)]).collect()
    assert found["template"].count("/") == 5000 and found["verdict"] == "allow" and time.time() - start < 60
    chain = [(i, "http://h.net/" + "/".join(["s"] * i)) for i in range(300)]
    rows = judged(chain, [(i, i < 150) for i in range(300)]).collect()
    assert len(rows) == 300 and {r["verdict"] for r in rows if r["page_id"] < 8} == {"allow"}


def test_very_many_sections_set_apart(judged):
    """More bad sections than a node has entries for are taken together by their share, and stay blocked."""
    pages = [(i, f"http://h.net/s-{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}/p") for i in range(3000)]
    pages += [(10_000 + i, f"http://h.net/ok-{chr(97 + i % 26)}/p") for i in range(20_000)]
    labels = [(i, False) for i in range(3000)] * 1 + [(10_000 + i, True) for i in range(20_000)]
    pages, labels = pages + [(50_000 + i, u) for i, u in pages[:3000]] + [(60_000 + i, u) for i, u in pages[:3000]], labels + [(50_000 + i, False) for i in range(3000)] + [(60_000 + i, False) for i in range(3000)]
    found = {r["page_id"]: r["verdict"] for r in judged(pages, labels).collect()}
    assert {found[i] for i in range(3000)} == {"block"} and {found[10_000 + i] for i in range(20_000)} == {"allow"}
