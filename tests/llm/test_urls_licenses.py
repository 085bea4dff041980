import hashlib
import math
import random
import re
import statistics
import time
import zlib

import pytest

from grainmill.llm import licenses, urls

from .helpers import docs, empty, rows

PAGES = [
    (1, "https://www.Example.COM/en/1"), (2, "http://example.com/en/2?q=1"), (3, "http://a.b.com/x#f"), (4, "http://x.net/es/9"),
    (5, "http://x.net/en/9"), (6, "http://com.org/"), (7, None), (8, "no scheme/at all"), (9, "http://example.com"), (10, "http://notexample.com/en/"),
    (11, "https://y.net/fr/1://z"), (11, "https://y.net/fr/1://z"), (12, ""), (13, "a://B/C?d"), (14, "http://q.example.com/en/"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string").selectExpr("*", "1 AS gram", "'x' AS shape")
    found = urls.judge(table).collect()
    assert len(found) == len(PAGES)
    want = sorted(((i, *plain(u)) for i, u in PAGES), key=str)
    assert sorted(((r.page_id, r.host, r.path) for r in found), key=str) == want
    for r in found:
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert {r.rule for r in found if r.page_id in (2, 14)} == {"example.com/en/"} and [r.rule for r in found if r.page_id == 9] == [None]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_models_tell_kinds_apart(spark):
    good = [(i, f"http://news{chr(97 + i % 26)}.com/article/{'xyzuv'[i % 5]}-story") for i in range(120)]
    bad = [(200 + i, f"http://casino{chr(97 + i % 26)}.net/es/win-money-{'xyzuv'[i % 5]}") for i in range(120)]
    open_ = [(500, "http://news7.org/article/story-of"), (501, "http://casino.org/xx/win-money-now")]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(good + bad + open_, "page_id long, url string")).collect()}
    assert found[500].verdict == "allow" and found[501].verdict == "block" and found[500].score > found[501].score


def test_models_read_all_ruled_urls(spark):
    def found(extra):
        good = [(i, f"http://news{chr(97 + i % 26)}.com/article/{'abcde'[i // 26]}") for i in range(130)]
        bad = [(200 + i, f"http://site{chr(97 + i % 26)}.net/es/{'abcde'[i // 26]}") for i in range(130)]
        table = spark.createDataFrame(good + bad + extra + [(500, "http://b.org/qjxz")], "page_id long, url string")
        return next(r.score for r in urls.judge(table, sample=10).collect() if r.page_id == 500)

    bare = found([])
    assert found([(600 + i, f"http://c.com/{'long/' * 60}{'abcdefghijkl'[i]}/qjxz") for i in range(12)]) > bare + 0.5
    assert found([(600 + i, f"http://c.net/es/{'abcdefghijkl'[i]}/qjxz") for i in range(12)]) < bare - 0.5


def plain_shape(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    return "^" + re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), rest)) + "$"


def plain_judge(pages, sample, order=urls.ORDER):
    """(page_id, verdict, score) by counts in dictionaries: the longest gram's smoothed probability under each model."""
    ruled = [(i, plain_shape(u), plain_rule(*plain(u))) for i, u in pages]
    known = {(s, v == "allow") for _, s, (_, v) in ruled if v}
    even = lambda s: zlib.crc32(s.encode()) % 2 == 0
    held = [k for good in (True, False) for k in sorted((k for k in known if k[1] == good), key=lambda k: (even(k[0]), hashlib.md5(k[0].encode()).hexdigest(), k[0]))[:sample]]
    seen = known - {k for k in held if not even(k[0])}
    counts, contexts = {True: {}, False: {}}, {True: {}, False: {}}
    for s, good in seen:
        for end in range(1, len(s) + 1):
            for size in range(1, min(order, end) + 1):
                gram = s[end - size : end]
                counts[good][gram] = counts[good].get(gram, 0) + 1
                contexts[good][gram[:-1], size] = contexts[good].get((gram[:-1], size), 0) + 1

    def chance(gram, good):
        shorter = chance(gram[1:], good) if len(gram) > 1 else 1 / urls.ALPHABET
        return (counts[good].get(gram, 0) + urls.MASS * shorter) / (contexts[good].get((gram[:-1], len(gram)), 0) + urls.MASS)

    def score(s):
        total = 0.0
        for end in range(1, len(s) + 1):
            longest = next((s[end - k : end] for k in range(min(order, end), 0, -1) if s[end - k : end] in counts[True] or s[end - k : end] in counts[False]), None)
            total += math.log(chance(longest, True) / chance(longest, False)) if longest else 0
        return total / len(s)

    figures = []
    for good in (True, False):
        own = [score(s) for s, g in held if g == good and not even(s)] or [score(s) for s, g in held if g == good]
        figures += [statistics.fmean(own), statistics.pstdev(own)]
    ma, sa, mr, sr = figures
    limit = (ma * sr + mr * sa) / (sr + sa) if sr + sa else (ma + mr) / 2
    return [(i, v or ("allow" if score(s) >= limit else "block"), None if v else score(s)) for i, s, (_, v) in ruled]


@pytest.mark.parametrize("sample", [7, 4000])
def test_scores_threshold_and_verdicts_like_plain_python(spark, sample):
    rng = random.Random(sample)
    word = lambda: "".join(rng.choice("aeimnrstäß09") for _ in range(rng.randrange(2, 9)))
    pages = [(i, f"http://{word()}.{rng.choice(['com', 'net', 'org', 'example.com'])}/{rng.choice(['es', 'fr', 'en', 'x'])}/{word()}/{'win-' * rng.randrange(3)}{word()}") for i in range(400)]
    pages += [(900, None), (901, "http://q.org/" + "long/story-" * 300)]
    got = {r.page_id: (r.verdict, r.score) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), sample=sample).collect()}
    for i, verdict, score in plain_judge(pages, sample):
        assert got[i][0] == verdict and (got[i][1] == score if score is None else abs(got[i][1] - score) < 1e-9), pages[i if i < 400 else i - 900 + 400]


def test_work_is_in_proportion_to_the_length(spark):
    rules = [(i, f"http://a{'bcdefgh'[i % 7]}.{['com', 'net'][i % 2]}/es/{i}") for i in range(40)]
    judge = lambda n: urls.judge(spark.createDataFrame([*rules, (99, "http://a.org/" + "ab/cd-" * (n // 6))], "page_id long, url string")).where("page_id = 99").first().score
    judge(100)
    began = time.time()
    short = judge(1_000)
    took = time.time() - began
    began = time.time()
    long = judge(1_000_000)  # four million grams
    assert time.time() - began < took + 60 and abs(short - long) < 0.1


def test_scan(spark):
    extra = [
        (50, "Released under the MIT License.", {"mit", "mit-notice"}),
        (51, "Licensed under CC BY-NC 4.0.", {"cc-by-nc-notice"}),
        (52, "x Licensed under the GNU General Public License, version 3. The MIT license; mit LICENSE", {"gpl", "gpl-3.0-notice", "mit"}),
        (53, "omit license, mit licenses, apache  (license)", {"apache"}),
        (54, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", {"isc"}),
        (55, "general public\nlicense émit license", {"gpl"}),
        (56, "permission is hereby granted to nobody", set()),
    ]
    data = rows() + [(i, t, "en", "s", 0, "", "", 0) for i, t, _ in extra]
    found = licenses.scan(docs(spark, data)).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    want = []
    for i, t, *_ in data:
        words = word.findall((t or "").translate(low))
        hits = [(k, label) for p, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want.append((i, len(words), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r for r in found}
    for i, _, labels in extra:
        assert by_id[i].labels == ",".join(sorted(labels)), i
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)
    assert by_id[50].score == 1 and by_id[3].score == 0
    assert licenses.scan(empty(spark)).collect() == []


def test_automaton():
    a = licenses.compile_template("x", "one [two three] {2} four [five]")
    for text, n in (("one four", 2), ("one two three four five", 5), ("one a b four", 4), ("one two three a b four", 6), ("one a b c four", 0), ("one two four", 3), ("one", 0)):
        assert a.run([w.encode() for w in text.split()], 0)[0] == n, text
    for bad in ("[a]", "[a", "a ]", "[a [b] c", "{2}", "a {2", "a 2}", "[a] {1-2}"):
        with pytest.raises(ValueError):
            licenses.compile_template("x", bad)


def ends(parts, words, at):
    """Places where a match of nested template parts can end, by plain recursion."""
    if not parts:
        return {at}
    kind, value = parts[0]
    out = ends(parts[1:], words, at) if kind == "optional" else set()
    if kind == "optional":
        return out.union(*(ends(parts[1:], words, e) for e in ends(value, words, at)))
    if kind == "words":
        return ends(parts[1:], words, at + 1) if at < len(words) and words[at] in value else set()
    least, most, pattern = value
    for n in range(least, most + 1):
        if at + n <= len(words) and all(re.fullmatch(pattern, w) for w in words[at : at + n]):
            out |= ends(parts[1:], words, at + n)
    return out


def written(parts):
    """The markup of nested template parts."""
    signs = {"optional": lambda v: f"[{written(v)}]", "words": lambda v: v[0] if len(v) == 1 else "{" + "|".join(v) + "}", "any": lambda v: f"{{{v[0]}-{v[1]}:{v[2]}}}" if v[2] != ".+" else f"{{{v[0]}-{v[1]}}}"}
    return " ".join(signs[kind](value) for kind, value in parts)


def drawn(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["words", "words", "any", "optional"] if depth < 3 else ["words"])
        least = rng.randint(0, 1)
        value = {"words": lambda: rng.sample("abc", rng.randint(1, 2)), "any": lambda: (least, least + rng.randint(1, 2), rng.choice([".+", "[ab]", "[0-9]+"])), "optional": lambda: drawn(rng, depth + 1)}[kind]()
        parts.append((kind, value))
    return parts


def test_automata_accept_what_plain_recursion_accepts():
    rng, taken = random.Random(8), 0
    for _ in range(400):
        parts = [*drawn(rng), ("words", [rng.choice("abc")])]
        automaton = licenses.compile_template("x", written(parts))
        for _ in range(20):
            words = [rng.choice(["a", "b", "c", "7"]) for _ in range(rng.randint(0, 9))]
            want = max(ends(parts, words, 0), default=0)
            assert automaton.run([w.encode() for w in words], 0)[0] == want, (written(parts), words)
            taken += want > 0
    assert taken > 500


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS “AS IS” AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "3. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


@pytest.mark.parametrize(
    "text, labels",
    [
        (BSD % "", {"bsd-notice", "bsd-2-clause"}),
        (BSD % THIRD, {"bsd-notice", "bsd-3-clause"}),
        ((BSD % "").replace("SPECIAL,", ""), {"bsd-notice"}),
        ((BSD % "").replace("1.", "").replace("2.", ""), {"bsd-notice", "bsd-2-clause"}),
        ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file', {"apache-2.0-notice"}),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", {"gpl-notice", "gpl-3.0-notice"}),
        ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-notice"}),
        ("Licensed under a Creative Commons Attribution 4.0 International License", {"cc-by-notice"}),
        ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright © 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", {"agpl-3.0-notice"}),
        ("redistribution and use of the general library are subject to permission", set()),
    ],
)
def test_wordings(text, labels):
    low = text.translate({c: c + 32 for c in range(65, 91)}).encode()
    assert {x[0] for x in licenses.Scanner().templates(low)[0]} == labels


def test_a_wording_may_leave_its_disclaimer_out_and_counts_it_where_it_stands():
    grant = licenses.TEMPLATES[1][1].partition(" [the software is")[0].replace("[or]", "or")
    disclaimer = licenses.TEMPLATES[1][1].partition(" [the software is")[2].rstrip("]").replace("{as|“as} {is|is”}", "as is").replace("{1-6}", "the author")
    for text in (grant, grant + " the software is" + disclaimer):
        assert licenses.Scanner().templates(text.encode())[0] == [("isc", 0, len(text.split()))]


@pytest.mark.parametrize("label", [w[0] for w in licenses.WHOLE])
def test_whole_texts_of_long_licences(label):
    text = licenses.whole_text(label)
    scanner = licenses.Scanner()
    found = lambda t: {x[0] for x in scanner.templates(t.encode().lower())[0]}
    automaton = next(a for a in licenses.AUTOMATA if a.label == label)
    hit = [x for x in scanner.templates(text.encode().lower())[0] if x[0] == label]
    assert [n for _, _, n in hit] == [automaton.done[-1]]
    commented = "// " + text.replace("\n", "\n// ")
    typographic = re.sub(r'"(?=\w)', "“", text).replace('"', "”")
    for changed in (commented, " ".join(text.split()), "before it, words " + text + " and after it", typographic):
        assert label in found(changed)
    words = list(re.finditer(r"[A-Za-z]{4,}", text))
    rng = random.Random(label)
    inside = [m for m in words if hit[0][1] < len(licenses.WORD.findall(text[: m.start()].encode())) < hit[0][1] + hit[0][2] - 1]
    for m in rng.sample(inside, 5):  # each of its words is mandatory, and none may come in between
        assert label not in found(text[: m.start()] + text[m.end() :])
        assert label not in found(text[: m.start()] + "other " + text[m.start() :])
    assert not {w[0] for w in licenses.WHOLE} & found(text[: len(text) // 2])


def test_own_templates_and_texts(spark):
    with pytest.raises(ValueError):
        licenses.template_of("one two three", "two", "four")
    assert licenses.template_of('Start. One "two" three; "four five." end. More', "one", "end") == "one {two|“two”} three {four|“four} five [{“|”}] end"
    own = (licenses.compile_template("house", licenses.template_of("You may keep this page", "you", "page")),)
    got = licenses.scan(docs(spark, [(1, "YOU may keep\nthis page", "en", "s", 0, "", "", 0), (2, "released under the mit license", "en", "s", 0, "", "", 0)]), own)
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "house", 2: "mit"}


def test_threshold_and_models_take_all_urls(spark):
    """the threshold stood on 4000 URLs of each verdict, which the models left out."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeimnrst09") for _ in range(rng.randrange(2, 9)))
    pages = [(i, f"http://{word()}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es', 'fr', 'en', 'x'])}/{word()}") for i in range(300)]
    ruled = [(i, plain_shape(u), plain_rule(*plain(u))[1]) for i, u in pages]
    known = sorted({(s, v == "allow") for _, s, v in ruled if v})

    def scorer(seen):
        counts, contexts = {}, {}
        for s, good in seen:
            for end in range(1, len(s) + 1):
                for size in range(1, min(urls.ORDER, end) + 1):
                    gram = s[end - size : end]
                    counts[good, gram] = counts.get((good, gram), 0) + 1
                    contexts[good, gram[:-1], size] = contexts.get((good, gram[:-1], size), 0) + 1

        def chance(gram, good):
            shorter = chance(gram[1:], good) if len(gram) > 1 else 1 / urls.ALPHABET
            return (counts.get((good, gram), 0) + urls.MASS * shorter) / (contexts.get((good, gram[:-1], len(gram)), 0) + urls.MASS)

        def ratio(s, end):
            ends = (s[end - k : end] for k in range(min(urls.ORDER, end), 0, -1))
            longest = next((g for g in ends if (True, g) in counts or (False, g) in counts), None)
            return math.log(chance(longest, True) / chance(longest, False)) if longest else 0.0

        return lambda s: sum(ratio(s, end) for end in range(1, len(s) + 1)) / len(s)

    even = lambda s: zlib.crc32(s.encode()) % 2 == 0
    other = {half: scorer([k for k in known if even(k[0]) != half]) for half in (True, False)}
    points = {good: [other[even(s)](s) for s, g in known if g == good] for good in (True, False)}
    (ma, sa), (mr, sr) = ((statistics.fmean(x), statistics.pstdev(x)) for x in (points[True], points[False]))
    limit, whole = (ma * sr + mr * sa) / (sr + sa), scorer(known)
    got = {r.page_id: (r.verdict, r.score) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    for i, s, v in ruled:
        assert got[i][0] == (v or ("allow" if whole(s) >= limit else "block"))
        assert got[i][1] is None if v else abs(got[i][1] - whole(s)) < 1e-9
