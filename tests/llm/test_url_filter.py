"""URL filter against plain versions: every split of a piece, a dictionary model."""

import itertools
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tapeworks.llm import url_filter as U

SHAPE = "page_id long, url string, html string, host string, tokens string, says string, score int"


def split_cost(words, counts, total):
    return sum(math.floor(1e6 * math.log(counts[w] / total)) if w in counts
               else math.floor(1e6 * math.log(10 / total)) - U.TENTH * len(w) for w in words)


def every_split(piece):
    for marks in itertools.product([0, 1], repeat=len(piece) - 1):
        cuts = [0, *[i + 1 for i, m in enumerate(marks) if m], len(piece)]
        yield [piece[a:b] for a, b in zip(cuts, cuts[1:])]


def plain(rows, rules=U.RULES):
    counts = Counter(m[1] for _, _, html in rows for t in re.split(r"[ \t\n\x0b\x0c\r]+", re.sub("<[^<>]*>", " ", html or ""))
                     if (m := re.fullmatch(r"[^a-zA-Zß]*([a-zA-Zß]+)[^a-zA-Zß]*", t)))
    counts = Counter({w.lower(): 0 for w in counts}) + Counter(w.lower() for w in counts.elements())
    total = sum(counts.values()) or 1
    pages, best = [], {}
    for i, url, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(r), r, says) for says, r in rules
                if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, says = max(fits)[1:] if fits else (None, None)
        tokens = []
        for piece in re.findall(r"[a-zß]{1,256}|[0-9]+", host):
            if piece[0].isdigit():
                tokens.append(f"#{len(piece)}")
            else:
                if piece not in best:
                    best[piece] = max(every_split(piece), key=lambda w: (split_cost(w, counts, total), [len(x) for x in w[::-1]]))
                tokens += best[piece]
        parts = [f"#{len(t)}" if t[0].isdigit() else t for t in re.findall(r"[a-zß]+|[0-9]+", path.lower())]
        pages.append((i, host, path, rule, says, tokens, ["h:" + t for t in tokens] + ["p:" + t for t in parts]))
    seen = {s: Counter(t for p in pages if p[4] == s for t in p[6]) for s in ("block", "allow")}
    size = len(set(seen["block"]) | set(seen["allow"])) + 1
    number = {s: sum(p[4] == s for p in pages) for s in seen}

    def odds(b, a, all_b, all_a):
        return math.floor(1e6 * (math.log((b + 1) / all_b) - math.log((a + 1) / all_a)))

    all_b, all_a = (sum(seen[s].values()) + size for s in ("block", "allow"))
    out = []
    for i, host, path, rule, says, tokens, names in pages:
        score = odds(number["block"], number["allow"], 1, 1) + sum(odds(seen["block"][t], seen["allow"][t], all_b, all_a) for t in names)
        out.append((i, host, path, rule, says or ("block" if score > 0 else "allow"), score, " ".join(tokens)))
    return sorted(out, key=str)


def pages(n=300, seed=2):
    rng = random.Random(seed)
    words = ["th", "tion", "ble", "sh", "casino", "win", "the", "ads", "net"]
    rows = []
    for i in range(n):
        host = "".join(rng.choices(words[:6], k=rng.choice([1, 2, 2]))) if rng.random() < 0.7 else "theads"
        host = rng.choice(["www.", "M.", "", "x2."]) + host + rng.choice([".example.org", ".com", ".example.com", ".net", ".EXAMPLE.org"])
        path = rng.choice(["/es/", "/en/1", "/en/2", "/fr/", "/de/", "", "/"]) + str(rng.randrange(2000)) + rng.choice(["", ".html", "/Win"])
        rows.append((i, rng.choice(["http", "https"]) + "://" + host + path + rng.choice(["", "?q=1://x/es/", "#a/b"]),
                     f"<p>{' '.join(rng.choices(words, k=6))}</p> (Win), nowin.example.com <<br> < straße"))
    return rows + [(None, rows[0][1], None), (5, rows[5][1], ""), (5, rows[5][1], "a"), (900, None, "x"), (901, "", "x"), (902, "nothing", None),
                   (903, "://", "x"), (904, "a://?q", "x"), (905, "a://org", "x"), (906, "a://org/", "x"), (907, "a://norg/", "x"),
                   (908, "a://b.com/fr/\n/x", "x"), (909, "\n://example.org/es/", "x"), (910, "a://1.2.3.4/de/", "x")]


def test_same_as_plain(spark):
    rows = pages()
    df = spark.createDataFrame([(i, u, h, "h", "t", "s", 3) for i, u, h in rows], SHAPE).repartition(5)
    got = U.judge(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score", "words"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_best_split_is_the_best_of_all(spark):
    rng = random.Random(4)
    cases = []
    for i in range(60):
        counts = Counter("".join(rng.choices("ab", k=rng.randrange(1, 5))) for _ in range(40))
        cases.append((i, "".join(rng.choices("ab", k=rng.randrange(1, 10))), {w: math.floor(1e6 * math.log(n / 40)) for w, n in counts.items()}, counts))
    cases.append((60, "xyz", None, Counter()))
    df = spark.createDataFrame([c[:3] for c in cases], "i int, piece string, known map<string,bigint>")
    unknown = math.floor(1e6 * math.log(10 / 40))
    got = {r.i: r.words for r in df.select("i", U.best_split(F.col("piece"), F.col("known"), unknown).alias("words")).collect()}
    for i, piece, _, counts in cases:
        assert "".join(got[i]) == piece
        assert split_cost(got[i], counts, 40) == max(split_cost(w, counts, 40) for w in every_split(piece))


def test_long_and_none(spark):
    long = [(1, "http://" + "ab" * 50_000 + ".com/de/" + "x" * 1_000_000, "ab " * 200_000), (2, "http://" + "a." * 20_000 + "net/q", "<" * 500_000)]
    df = spark.createDataFrame([(*r, "h", "t", "s", 3) for r in long], SHAPE)
    got = {r.page_id: r for r in U.judge(df).collect()}
    assert got[1].verdict == "block" and got[1].rule == "com/de/" and set(got[1].words.split()) == {"ab", "com"}
    assert len(got[2].words.split()) == 20_001
    assert U.judge(df.where("page_id > 5")).collect() == []


def test_unruled_pages_follow_what_the_rules_decide(spark):
    rows = [(i, f"http://casinowin.com/de/{i}", "casino win good read") for i in range(20)]
    rows += [(100 + i, f"http://goodread.com/fr/{i}", "") for i in range(20)]
    rows += [(200, "http://wincasino.net/en/1", ""), (201, "http://readgood.net/en/1", "")]
    df = spark.createDataFrame([(*r, "h", "t", "s", 3) for r in rows], SHAPE)
    got = {r.page_id: (r.verdict, r.words) for r in U.judge(df).where("page_id >= 200").collect()}
    assert got == {200: ("block", "win casino net"), 201: ("allow", "read good net")}
