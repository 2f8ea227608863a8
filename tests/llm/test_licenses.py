import re

from plotweld.llm import licenses

GPL3 = "GNU General Public License, version 3"
NOTICE = licenses._gnu_notice("program", "General", "3")


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.matches for r in licenses.license_scan(spark, docs).collect()}


def names(spark, texts):
    got = found(spark, texts)
    return [[m.license for m in got[i]] for i in range(len(texts))]


def test_what_stands_behind_a_version(spark):
    cases = {
        f"This work is licensed under the {GPL3}.": ["GPL-3.0"],
        f"This work is licensed under the {GPL3}. 1 January": ["GPL-3.0"],
        f"This work is licensed under the {GPL3}.1": [],
        f"This work is licensed under the {GPL3} or later.": ["GPL-3.0-or-later"],
        f"This work is licensed under the {GPL3}, or (at your option) any later version.": ["GPL-3.0-or-later"],
        f"This work is licensed under the {GPL3} or any later version": ["GPL-3.0-or-later"],
        f"This work is licensed under the {GPL3} or": ["GPL-3.0"],
        f"This work is licensed under the {GPL3}+": ["GPL-3.0-or-later"],
        f"Licensed under the {GPL3}.": ["GPL-3.0"],
        "Licensed under the GNU Lesser General Public License v2.1": ["LGPL-2.1"],
        "Licensed under the GNU General Public License v9": [],
        "Licensed under the GNU General Public License, version 9": [],
        "Licensed under the GNU General Public License v3.0": ["GPL-3.0"],
        "Licensed under the GNU General Public License v3.5": [],
        "released under the GPL-3.0-or-later license": ["GPL-3.0-or-later"],
        "released under the EUPL-1.2 license": ["EUPL-1.2"],
        "released under the XPL-3.0 license": [],
        NOTICE: ["GPL-3.0-or-later"],
        NOTICE.replace("version 3", "version 2"): ["GPL-2.0-or-later"],
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
    }
    assert dict(zip(cases, names(spark, list(cases)), strict=True)) == cases


def test_spdx_lines(spark):
    cases = {
        "// SPDX-License-Identifier: MIT\nint main": ["MIT"],
        "SPDX-License-Identifier: MIT-0": ["MIT-0"],
        "SPDX-License-Identifier: MIT-Modern": [],
        "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0"],
        "SPDX-License-Identifier: GPL-2.0-only\n": ["GPL-2.0"],
        "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: GPL-2.0.1": [],
        "SPDX-License-Identifier: Apache-2.0 OR MIT": ["Apache-2.0", "MIT"],
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-or-later": ["MIT", "Apache-2.0", "GPL-3.0-or-later"],
        "SPDX-License-Identifier: MIT\nor Apache-2.0": ["MIT"],
        "SPDX-License-Identifier: NONE": [],
        "SPDX-License-Identifier:": [],
    }
    assert dict(zip(cases, names(spark, list(cases)), strict=True)) == cases
    (first, second) = found(spark, ["é SPDX-License-Identifier: Apache-2.0 OR MIT, z"])[0]
    assert (first.start, first.end, second.start, second.end) == (2, 37, 41, 44) and second.coverage == 1.0


def test_every_exact_template_is_found_once(spark):
    texts = [t for _, t in licenses.EXACT]
    got = found(spark, [f"head {t} tail" for t in texts] + [t for t in texts])
    for i, (name, t) in enumerate(licenses.EXACT):
        for at, k in ((i, 5), (i + len(texts), 0)):
            assert [(m.license, m.start, m.end) for m in got[at]] == [(name, k, k + len(t.rstrip(":")))], t
    # A line or title with one word exchanged is none.
    lines = [t for _, t in licenses.EXACT if t.startswith(licenses.SPDX)] + [t for _, t in licenses.EXACT[-9:]]
    assert not any(names(spark, [re.sub(r"(?i)\b(license|public|legal)\b", "zz", t, count=1) for t in lines]))


def test_whole_texts_of_the_short_licenses(spark):
    whole = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense")}
    numbered = whole["BSD-3-Clause"].replace("Redistributions of source", "1. Redistributions of source").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    got = found(spark, [*whole.values(), numbered, licenses.BSD_DISCLAIMER, "\n".join([whole["Zlib"], whole["BSD-2-Clause"]])])
    for i, (name, t) in enumerate(whole.items()):
        assert [(m.license, m.start, m.coverage) for m in got[i]] == [(name, 0, 1.0)] and got[i][0].end >= len(t) - 1
    n = len(whole)
    assert [m.license for m in got[n]] == ["BSD-3-Clause"] and got[n][0].end >= len(numbered) - 1
    assert [m.license for m in got[n + 1]] == ["BSD"] and [m.license for m in got[n + 2]] == ["Zlib", "BSD-2-Clause"]


def test_plain_texts_have_no_license(spark):
    texts = ["the later version of this work is licensed to nobody", "version 3 or later", "under the license", "public license version 2", "MIT or Apache 2.0", "identifier: MIT", "general public"]
    assert not any(names(spark, texts))
