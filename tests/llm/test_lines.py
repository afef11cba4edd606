"""Line dedup against plain counting."""

from collections import Counter, defaultdict

from quire.llm import lines as L


def brute(pages):
    by_host = defaultdict(list)
    for host, ls in pages:
        by_host[host].append(ls)
    out = []
    for host, ls in pages:
        n = Counter(x for page in by_host[host] for x in set(page or ()))
        bad = {x for x, k in n.items() if k >= L.MIN_PAGES and k > L.RATIO * len(by_host[host])}
        out.append((host, len(ls or ()), sum(x in bad for x in ls or ()), None if ls is None else "\n".join(x for x in ls if x not in bad)))
    return sorted(out, key=str)


def test_equals_plain_counting(spark):
    pages = [("big", [f"t{i}", "menu", "menu", f"s{i % 4}", f"r{i % 9}"]) for i in range(200)]
    pages += [("small", ["menu", "own"]), ("small", ["menu", "own"]), ("mid", ["a"]), ("mid", ["a", "b"]), ("mid", ["a"]), ("", None), ("", []), ("x.y", ["q"] * 5)]
    df = spark.createDataFrame([(i, h, ls, "z") for i, (h, ls) in enumerate(pages)], "n int, h string, lines array<string>, deduplicated string")
    out = L.deduplicated_lines(df, df["h"], df["lines"])
    got = sorted((tuple(r["deduplicated"]) for r in out.collect()), key=str)
    assert got == brute(pages) and "z" not in str(got)
    assert any(d for _, _, d, _ in got)


def test_pages(spark):
    foot = "<footer>All &copy; rights</footer>"
    rows = [(i, f"https://user@Site.org:80/{i}?q", f"<head><title>T{i}</title><script>x</script></head><p>own {i}</p>{foot}") for i in range(5)]
    rows += [(10, None, foot), (11, "not a url", "<p>a\n b<br>c"), (12, "http://other.net", None), (13, "ftp://other.net/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in L.page_lines(pages).collect()}
    assert got[3] == ("site.org", 3, 1, "T3\nown 3")
    assert got[10] == ("", 1, 0, "All © rights") and got[11] == ("", 2, 0, "a b\nc")
    assert got[12] == ("other.net", 0, 0, None) and got[13] == ("other.net", 0, 0, "")
    assert L.page_lines(pages.limit(0)).count() == 0
