import datetime

import pytest

from quarrymill.llm import licences, names

ENTRIES = [
    (1, "declared_license", "MIT", "MIT License"), (2, "declared_license", "Apache-2.0", "Apache License 2.0"), (3, "declared_license", "BSD-2-Clause", "BSD 2-Clause License"),
    (4, "declared_license", "BSD-3-Clause", "BSD 3-Clause License"), (5, "declared_license", "GPL-2.0-only", "GNU General Public License 2.0"), (6, "declared_license", "GPL-3.0-only", "GNU General Public License 3.0"),
    (7, "declared_license", "CC0-1.0", "Creative Commons Zero 1.0 Universal"), (8, "declared_license", "CC-BY-4.0", "Creative Commons Attribution 4.0"), (9, "declared_license", "0BSD", "BSD Zero Clause License"),
    (11, "allowed_tools", "Read", "Read"), (12, "allowed_tools", "PageFetcher", "Page Fetcher"), (13, "allowed_tools", "Edit", "Edit"),
]
NOTICE = {"MIT": "Anyone may copy this work, or bundle this work, as long as changed files say so. It comes as it is.", "Apache-2.0": "Anyone may run this work anywhere, as long as no maker is named. No promise is made."}


@pytest.mark.parametrize(
    "value,ref",
    [
        ("MIT", 1), (" mit. ", 1), ("The MIT Licence", 1), ('"MIT License"', 1), ("MIT Liecnse", 1), ("Licensed under the MIT License (see LICENSE)", 1), ("ＭＩＴ", 1),
        ("apache2", 2), ("ASL 2.0", 2), ("Apache License, Version 2.0", 2), ("Aapche Licese 2.0", 2), ("BSD (2 clause)", 3), ("New BSD, 3 clauses", 4), ("bsd3", 4), ("GPLv3", 6), ("GPL 2", 5), ("GNU GPL version 3", 6),
        ("cc0", 7), ("CC BY 4.0", 8), ("Zero-Clause BSD", 9), ("GPL", 0), ("BSD", 0), ("Creative Commons", 0), ("TBD", 0), ("n/a", 0), ("proprietary", 0), ("GPL-4.0-only", 0), ("MIT only for code in this folder", 1),
        ("MTI", 1), ("MITT", 1), ("MUT", 0), ("GPL-3.0-or-later", 6), ("GPLv3+", 6), ("GPL 2 or any later version", 5), ("Creative Commons Attribution 4.0 International", 8),
    ],
)
def test_licence_names(value, ref):
    assert names.Resolver(ENTRIES).resolve("declared_license", value) == ref


@pytest.mark.parametrize("value,ref", [("read", 11), ("Read(path=./docs)", 11), ("mcp__desk__Raedd", 11), ("`Page_Fetcher` ;", 12), ("page fetcher,", 12), ("pgaefetcherr", 12), ("tool:Edit", 13), ("all", 0), ("*", 0), ("?", 0), ("Gravel(x:*)", 0), ("none", 0)])
def test_tool_names(value, ref):
    assert names.Resolver(ENTRIES).resolve("allowed_tools", value) == ref


def test_slips_against_brute_force():
    import itertools
    import random

    def plain(a, b):
        d = {(-1, -1): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i == 0 or j == 0:
                    d[i, j] = i + j
                    continue
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for a, b in itertools.product(words, words):
        got, want = names.slips(a, b), plain(a, b)
        assert (got is None) == (want > 2) and (got is None or got[0] <= want + 1)
        if want <= 2:
            # within reach of the deletes: no candidate is lost
            assert names.deletes(a) & names.deletes(b)


def test_map_values(spark):
    t = datetime.datetime(2025, 1, 1)
    skills = spark.createDataFrame(
        [(1, "MIT", ["Read", None, " , ", "zzz"], t), (1, "GPL", ["x"], t - datetime.timedelta(1)), (2, None, None, t), (3, "  ", [], t), (3, "  ", [], t)],
        "skill_id long, declared_license string, allowed_tools array<string>, last_seen_at timestamp",
    )
    ref = spark.createDataFrame(ENTRIES, "reference_id int, field string, canonical_value string, long_name string")
    got = sorted(map(tuple, names.map_values(skills, ref).collect()))
    assert got == [(1, "allowed_tools", 0, 11), (1, "allowed_tools", 3, 0), (1, "declared_license", 0, 1)]
    assert {r.reference_id for r in names.map_values(skills, ref.where("false")).collect()} == {0}
    assert names.map_values(skills.where("false"), ref).count() == 0


@pytest.mark.parametrize(
    "text,plain,choice",
    [
        ("# SPDX-License-Identifier: MIT\ncode()", {"MIT"}, set()), ("// spdx-licence-identifier:apache-2.0", {"Apache-2.0"}, set()), ("/*\n * SPDX-License-Identifier: (MIT OR Apache-2.0)\n */", set(), {"MIT", "Apache-2.0"}),
        ("# Licensed under either the MIT License or the\n# Apache License 2.0, at your option.", set(), {"MIT", "Apache-2.0"}), ("# Dual licensed, pick one of: MIT / GPL-2.0-only", set(), {"MIT", "GPL-2.0-only"}),
        ("# Licensed under the MIT Liecnse.", {"MIT"}, set()), ("# X is free to use under GPLv3; see the LICENSE file.", {"GPL-3.0-only"}, set()), ("# @license BSD-2-Clause\nx = 1", {"BSD-2-Clause"}, set()),
        ("# Before 2020 the MIT License applied here. Today the Apache\n# License 2.0 does.", {"Apache-2.0"}, set()), ("# Until 2020 this file was under the MIT License; it is now under the Apache License 2.0.", {"Apache-2.0"}, set()),
        ("# Do not paste code under the MIT License into this folder.", set(), set()), ("# Output is compared with a tool that ships under the MIT.", set(), set()), ("# Scans other trees for the words MIT License.", set(), set()),
        ("# Do not stop until it is done!\n# Licensed under the MIT License.", {"MIT"}, set()), ("# License: see above.", set(), set()), ("# SPDX-License-Identifier:\nimport mit", set(), set()), ("# Example value: MIT", set(), set()),
        ("<!--\nANYONE MAY COPY THE FOO FILES OR BUNDLE THE FOO FILES, AS LONG\nAS CHANGED FILES SAY SO. IT COMES AS IT IS.\n-->", {"MIT"}, set()), ("MIT License\n\nSee the notes.", {"MIT"}, set()), ("", set(), set()), ("free for all", set(), set()),
        ("# Licensed under the MIT License.\n# SPDX-License-Identifier: Apache-2.0", {"MIT", "Apache-2.0"}, set()), ("# Licensed under the GPL.", set(), set()),
    ],
)
def test_stated(text, plain, choice):
    got = licences.Grammar(ENTRIES, list(NOTICE.items())).stated(text)
    assert (set(got[0]), set(got[1])) == (plain, choice)


def test_decide(spark):
    t = datetime.datetime(2025, 1, 1)
    repos = spark.createDataFrame([(1, "mit ", t), (2, None, t), (3, "MIT", t), (4, "NOASSERTION", t), (1, "mit ", t)], "github_repository_id long, license_spdx_id string, fetched_at timestamp")
    skills = spark.createDataFrame([(10, "Apache 2.0", t), (20, None, t), (30, "?", t), (40, None, t)], "skill_id long, declared_license string, last_seen_at timestamp")
    rows = [
        (1, None, 3, "Apache License 2.0\n\nnotes"), (2, 10, 1, "# x"), (3, 10, 1, "# SPDX-License-Identifier: MIT"), (4, 20, 1, None), (5, 20, 2, ""), (6, 30, 3, "# nothing"), (7, 20, 1, "# SPDX-License-Identifier: GPL-2.0-only OR MIT"),
        (8, 10, 1, "# SPDX-License-Identifier: GPL-2.0-only OR MIT"), (9, 40, 4, "# Licensed under the MIT License.\n# @license Apache-2.0"), (11, 99, 99, None), (7, 20, 1, "# SPDX-License-Identifier: GPL-2.0-only OR MIT"),
    ]
    files = spark.createDataFrame([(*r, t, "clash") for r in rows], "file_id long, skill_id long, repository_id long, header_text string, listed_at timestamp, flag string")
    ref = spark.createDataFrame([(*e, NOTICE.get(e[2])) for e in ENTRIES], "reference_id int, field string, canonical_value string, long_name string, notice_text string")
    got = {(r.scope, r.subject_id): (r.license, r.flag) for r in licences.decide(repos, skills, files, ref).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "repository"} == {1: ("MIT", "ok"), 2: ("NONE", "unknown"), 3: ("NONE", "conflict"), 4: ("NONE", "unknown")}
    assert {k[1]: v for k, v in got.items() if k[0] == "file"} == {
        2: ("Apache-2.0", "ok"), 3: ("MIT", "conflict"), 4: ("MIT", "ok"), 5: ("NONE", "unknown"), 6: ("NONE", "conflict"), 7: ("GPL-2.0-only OR MIT", "ok"), 8: ("GPL-2.0-only OR MIT", "conflict"), 9: ("NONE", "conflict"), 11: ("NONE", "unknown"),
    }
    assert licences.decide(repos.where("false"), skills.where("false"), files.where("false"), ref).count() == 0


def grammar():
    return licences.Grammar(ENTRIES, list(NOTICE.items()))


@pytest.mark.parametrize(
    "text,plain,choice",
    [
        ("This project ships under MIT.", {"MIT"}, set()), ("You may use this file under the MIT license.", {"MIT"}, set()), ("This file is subject to the Apache License 2.0", {"Apache-2.0"}, set()),
        ("# Output is compared with a tool that ships under the MIT License.", set(), set()), ("Another library is licensed under MIT.", set(), set()), ("This library, which is licensed under MIT, is small.", {"MIT"}, set()),
        ("Do not paste code under the MIT License into this folder.", set(), set()), ("No longer licensed under MIT.", set(), set()), ("If this is licensed under MIT, tell us.", set(), set()),
        ("// Until 2019 this file was under the GPL 3; it is now under\n// MIT.", {"MIT"}, set()), ("Before 2019 the GPL 3 applied here. Today the MIT License does.", {"MIT"}, set()),
        ("// SPDX-License-Identifier: MIT\n// Foo is free to use under Apache 2; see the LICENSE file.", {"MIT", "Apache-2.0"}, set()), ("License: see above\nReleased under MIT.", {"MIT"}, set()),
        ("The cache does. The healthy reply is here; the cache does not.", set(), set()), ("The MIT License does not apply.", set(), set()), ("The MIT License applies.", {"MIT"}, set()),
        ("Do not edit\nSPDX-License-Identifier: MIT", {"MIT"}, set()), ("License: see above.", set(), set()), ("Example value: MIT License", set(), set()), ("Scans other trees for the words MIT License.", set(), set()),
        ("Licensed under either the GNU General Public License 3.0 or the Apache\n License 2.0, at your option.", set(), {"GPL-3.0-only", "Apache-2.0"}), ("Dual licensed, pick one of: CC-BY-4.0 / MIT", set(), {"CC-BY-4.0", "MIT"}),
        ("Released under MIT and Apache-2.0.", {"MIT", "Apache-2.0"}, set()), ("/* GNU  General   Public      License    version    3 */", {"GPL-3.0-only"}, set()), ("", set(), set()),
    ],
)
def test_statements(text, plain, choice):
    assert tuple(map(set, grammar().stated(text))) == (plain, choice)


@pytest.mark.parametrize(
    "change,stated",
    [
        (lambda t: t, True), (str.upper, True), (lambda t: t.replace("this work", "the Foo files"), True), (lambda t: "# x\n# " + t.replace(", ", ",\n# ") + "\n# y", True),
        (lambda t: t.replace("changed files", "files"), True), (lambda t: t.replace("copy", "freely copy"), True), (lambda t: t.replace("say so", "tell so"), True), (lambda t: t.replace("as it is", "as is"), True),
        (lambda t: t.split(",")[0] + ".", False), (lambda t: t.replace("as long as changed files say so", "with no duty at all for anyone who does"), False), (lambda t: "w " * 3_000 + t + " w" * 3_000, True),
    ],
)
def test_notices_with_edits(change, stated):
    got = grammar().stated(change(NOTICE["MIT"]))
    assert got == (frozenset({"MIT"} if stated else ()), frozenset())


def test_name_of_many_words():
    """No number of words in a name is too many."""
    long = "The Very Long Name Of A Licence That Has More Than Nine Words In It"
    g = licences.Grammar([*ENTRIES, (20, "declared_license", "LONG-1", long)], [])
    assert g.stated(f"Licensed under the {long}.")[0] == {"LONG-1"} and g.stated("  ".join(long.split()) + " " * 60)[0] == {"LONG-1"}
