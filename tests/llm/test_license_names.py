"""Names, identifiers and addresses of licenses, by cases, and the run of a long template against all runs."""

import random

import pytest

from formloom.llm.license_scan import LicenseScanner, _run, expression_ids, template, templates

CASES = {
    "GNU GPL version 3 or newer": ["GPL-3.0-or-later"], "GPLv3+": ["GPL-3.0-or-later"], "GPLv2": ["GPL-2.0-only"], "LGPL-2.1+ is it": ["LGPL-2.1-or-later"], "GNU General Public License v3.0": ["GPL-3.0-only"],
    "GNU General Public License v3.0 or later": ["GPL-3.0-or-later"], "dual licensed under MIT or Apache-2.0": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0-only"],
    "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 AND mit": ["GPL-2.0-or-later", "MIT"], "spdx-license-identifier: isc\nMIT sits beside": ["ISC"], "SPDX-License-Identifier: see the file": [],
    "Apache 2.0": ["Apache-2.0"], "License: MIT": ["MIT"], "MIT-licensed": ["MIT"], "mit license": ["MIT"], "CC0": ["CC0-1.0"], "Creative Commons Zero v1.0 Universal": ["CC0-1.0"], "The 3-Clause BSD License": ["BSD-3-Clause"], "under the BSD license": ["BSD"],
    "see https://opensource.org/licenses/MIT": ["MIT"], "https://www.gnu.org/licenses/gpl-3.0.html": ["GPL-3.0-only"], "https://creativecommons.org/licenses/by-sa/4.0/": ["CC-BY-SA-4.0"], "https://www.apache.org/licenses/LICENSE-2.0": ["Apache-2.0"],
    "http://creativecommons.org/publicdomain/zero/1.0/": ["CC0-1.0"], "ein Haus mit Style License": [], "wir kommen mit Freude": [], "see the library, version 2.0": [], "C++ and 2+2": [],
}


@pytest.fixture(scope="module")
def scanner():
    return LicenseScanner(templates())


@pytest.mark.parametrize("text", sorted(CASES))
def test_names(scanner, text):
    for around in ("{}", "before it. {} after it, some words", "x\n{}\ny"):
        got = scanner.scan(around.format(text))
        assert sorted({g[2] for g in got}) == CASES[text], (around, got)
        assert all(around.format(text)[g[3] : g[4]].strip() == around.format(text)[g[3] : g[4]] for g in got)


def test_expressions():
    ids = lambda t: [i for _, _, i in expression_ids(t, 0)]
    assert ids("MIT AND (Apache-2.0 OR (GPL-2.0+ WITH x-exception)) and more") == ["MIT", "Apache-2.0", "GPL-2.0+", "more"]
    assert ids("MIT This file") == ["MIT"] and ids("(MIT") == ["MIT"] and ids("") == [] and ids("OR MIT") == [] and ids("MIT) OR ISC") == ["MIT"]
    assert len(ids("MIT OR " * 50_000 + "ISC")) == 50_001


@pytest.mark.parametrize("seed", range(5))
def test_run_of_a_long_template(seed):
    """Its score is the greatest of all runs'."""
    rng = random.Random(seed)
    at, pairs = 0, []
    for j in range(60):
        at += 1 if rng.random() < 0.7 else rng.randrange(1, 30)
        pairs.append((at, j))
    score = lambda p, q: (q - p + 1) - sum(pairs[k][0] - pairs[k - 1][0] - 1 for k in range(p + 1, q + 1)) / 4
    best = max(score(p, q) for p in range(60) for q in range(p, 60))
    _, n, first, last = _run(pairs, 60, 1)
    where = [a for a, _ in pairs]
    assert score(where.index(first), where.index(last)) == pytest.approx(best) and n == where.index(last) - where.index(first) + 1


def test_a_long_text_is_a_template():
    """Five thousand words, some of them worn, between others' words: found whole, in little time."""
    import time

    rng = random.Random(7)
    words = [rng.choice(["shall", "license", "work", "any", "the", "copy"]) + str(rng.randrange(900)) for _ in range(5000)]
    marked = " ".join(words[:2400]) + " [[" + " ".join(words[2400:2440]) + "]] " + " ".join(words[2440:])
    scan = LicenseScanner([template("Long-1.0", "text", marked)]).scan
    worn = [w for w in words if rng.random() > 0.04]
    worn[2000:2000] = words[2400:2440]
    noise = [f"n{rng.randrange(99)}" for _ in range(3000)]
    text = " ".join([*noise, *words[:1000], "extra", *words[1000:], *noise])
    began = time.process_time()
    (hit,) = scan(text)
    assert hit[2] == "Long-1.0" and hit[0] == 1.0 and time.process_time() - began < 30
    assert text[hit[3] : hit[4]].startswith(words[0]) and text[hit[3] : hit[4]].endswith(words[-1])
    assert scan(" ".join(noise)) == []
