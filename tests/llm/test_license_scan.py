import random
import re

from fluxframe.llm.license_scan import NOTICES, TEMPLATES, WHOLE, Template, align, license_query, longest_increasing, scan, scan_licenses

SF = "/root/testdata/sf0.01"
ALL = [Template(*t) for t in TEMPLATES]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_subsequence_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        v = rng.sample(range(30), 12)
        i = longest_increasing(v)
        got = [v[k] for k in i]
        assert i == sorted(i) and got == sorted(got) and len(got) == lcs(v, sorted(v))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(12)]
        b = [x for x in a if rng.random() < 0.8] + [rng.choice("klm")]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_planted_notices_are_found():
    rng = random.Random(3)
    for name, text in NOTICES + WHOLE:
        filler = lambda n: " ".join(rng.choice(("lorem", "ipsum", "the", "of", "version", "license", "and")) for _ in range(n))
        got = scan(f"{filler(40)}\n{text}\n{filler(300)}\n{text.upper()} {filler(30)}", ALL)
        assert [n for *_, n, _ in got].count(name) == 2
    whole = TEMPLATES[2][1].split()
    for k in range(0, len(whole), 9):
        whole[k] = "changed"
    assert [x[2] for x in scan("x " * 50 + " ".join(whole), ALL)] == ["MIT"]
    assert scan("the license of the version is under general public work", ALL) == []


def test_whole_table_agrees_with_plain_search(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: {n for n, t in NOTICES if re.search(re.escape(t.rstrip(".")), text)} for d, text in docs.items()}
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in license_query(spark, SF).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "é Licensed under CC BY-NC 4.0."), (5, "license permission " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, notices int")
    got = [(r.doc_id, [(n.license, n.start, n.end) for n in r.notices]) for r in scan_licenses(df).collect()]
    assert got == [(1, []), (2, []), (3, [("MIT", 0, 30)]), (3, [("MIT", 0, 30)]), (None, [("CC-BY-NC-4.0", 2, 29)]), (5, [])]
    assert scan_licenses(df.limit(0)).count() == 0


def test_edited_copy_beside_a_whole_one():
    mit = TEMPLATES[2][1]
    edited = " ".join(w for w in mit.split() if w.strip(",") not in ("charge", "person", "files"))
    for text in (f"{mit}\n{'x ' * 80}\n{edited}", f"{edited}\n{'x ' * 80}\n{mit}"):
        assert [n for *_, n, _ in scan(text, ALL)] == ["MIT", "MIT"]


def test_prefilter_drops_nothing_that_reaches_the_coverage():
    assert [n for *_, n, _ in scan("under CC BY 4.0", ALL)] == ["CC-BY-4.0"]
    assert [n for *_, n, _ in scan("released under the MIT", ALL)] == ["MIT"]
    rng = random.Random(4)
    for t in ALL:
        for _ in range(2 if len(t.words) > 400 else 20):  # as many words left out as the coverage allows
            gone = set(rng.sample(range(len(t.words)), len(t.words) - -int(-0.8 * len(t.words) // 1)))
            left = " ".join(w for i, w in enumerate(t.words) if i not in gone)
            pairs = align(t.words, left.split())
            if len(pairs) >= 0.8 * len(t.words) and t.told(pairs, 0.8):
                assert t.name in [n for *_, n, _ in scan(f"{'x ' * 80}{left}", ALL)]


def test_other_licences_are_not_taken_for_these():
    bsd = dict(NOTICES)["BSD-3-Clause"]
    two = bsd[: bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE IS") :]
    mit = TEMPLATES[2][1]
    no_attribution = mit.replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "")
    gpl = next(t for n, t in TEMPLATES if n == "GPL-3.0" and "redistribute" in t)
    others = [
        "Licensed under the BSD License.", "Licensed under CC BY 3.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Apache License, Version 1.1.", "Released under the MIT No Attribution License.",
        gpl.replace("version 3", "version 2"), gpl.replace("GNU General", "GNU Affero General"), gpl.replace("GNU General", "GNU Lesser General"), "This work is licensed under the GNU General Public License, version 2.", no_attribution,
    ]
    assert {t: scan(f"{'x ' * 40}{t}{' x' * 40}", ALL) for t in others} == {t: [] for t in others}
    assert [n for *_, n, _ in scan(bsd.replace("the copyright holder", "Example Ltd."), ALL)] == ["BSD-3-Clause"]
    assert [n for *_, n, _ in scan("Licensed under the Apache License 2.0", ALL)] == ["Apache-2.0"]
    assert [n for *_, n, _ in scan(two, ALL)] == ["BSD-2-Clause"] and [n for *_, n, _ in scan(bsd, ALL)] == ["BSD-3-Clause"]
    filled = " ".join(w for i, w in enumerate(bsd.split()) for w in ((w, "filler", "words") if i % 3 == 0 else (w,)))
    assert scan(filled, ALL) == []  # words put in count as well
