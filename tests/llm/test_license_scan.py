import random
import re

from weftline.llm import license_scan as L


def test_rules():
    rules = L.rules()
    assert len(rules) >= 300 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    for r in rules:
        re.compile(r.pattern)


def test_prefilter_loses_nothing():
    texts = ["spdx-license-identifier: mit", "released under the mit license.", "licensed under the apache license, version 2.0 see http://www.apache.org/licenses/license-2.0", "cc by-nc-sa 4.0", "this work is cc by 4.0 licensed", "gnu lesser general public license v3", "all rights reserved", "the unlicense", "bsd 3-clause license? simplified bsd license", "see https://opensource.org/licenses/mit", "under the\n  mit\n\tlicense", "gnu general\npublic license"]
    for t in texts:
        plain = [L.Detection(m.start(), m.end(), r.label, r.priority, r.weight) for r in L.rules() for m in re.finditer(r.pattern.replace(" ", r"\s+"), t)]
        assert L.detect(t) == L.suppress(plain) and L.detect(t)


def test_suppression():
    d = L.Detection
    inner, outer, apart = d(3, 5, "a", 10, 0.5), d(0, 9, "b", 40, 0.9), d(7, 12, "c", 10, 0.5)
    assert L.suppress([inner, outer, apart]) == [outer, apart]
    assert L.suppress([d(0, 4, "x", 10, 0.5), d(0, 4, "a", 10, 0.5)]) == [d(0, 4, "a", 10, 0.5)]


def test_places_and_operator(spark, docs, none):
    assert L.places(b"MIT License, mit license CC-BY cc by", L.BASE) == (8, [(0, "mit"), (2, "mit"), (4, "cc-by"), (6, "cc-by")])
    assert all(r.n_base == 0 and r.score == 0 and r.labels == [] for r in L.license_scan(docs).collect())
    assert L.license_scan(none).count() == 0
    one = L.license_scan(spark.createDataFrame([(1, "The GNU General Public License, version 3")], "doc_id int, text string")).first()
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels, one.labels) == (7, 1, 1, 1, ["gpl"], ["gpl"]) and 0 < one.score < 1 and one.detections[0].label == "gpl"


def test_compound_expressions():
    labels = lambda x: {d.label for d in L.detect(x.lower())}
    assert labels("// SPDX-License-Identifier: MIT OR Apache-2.0") == {"mit", "apache"}
    assert labels("// SPDX-License-Identifier: (ISC AND (Zlib OR MIT))") == {"isc", "zlib", "mit"}
    assert labels("// SPDX-License-Identifier: MIT\nor Apache-like") == {"mit"}


def test_blanks_beside_dashes():
    labels = lambda x: {d.label for d in L.detect(x)}
    assert labels("under cc  by\n4.0") == labels("under cc-by 4.0") == {"cc-by"}
    assert labels("cc+by 4.0") == set() and labels("cc by -nc") == labels("cc by")


def test_suppression_of_many():
    rng = random.Random(3)
    d = [L.Detection(a, a + rng.randint(1, 40), rng.choice("ab"), rng.choice((10, 20, 30)), 0.5) for a in rng.choices(range(400), k=300)]
    kept = []
    for x in sorted(set(d), key=lambda x: (-x.priority, x.start - x.end, x.start, x.label)):
        if not any(k.start <= x.start and x.end <= k.end for k in kept):
            kept.append(x)
    assert L.suppress(d) == sorted(kept, key=lambda x: (x.start, x.end, x.label)) and len(kept) < len(d)
    long = L.suppress([L.Detection(20 * i, 20 * i + 11, "mit", 10, 0.7) for i in range(200_000)])
    assert len(long) == 200_000
