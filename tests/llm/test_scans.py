"""Pseudonyms and license scans."""

import re

from kirana.llm.licenses import TEMPLATES, license_blocks
from kirana.llm.pseudonyms import luhn_digit, mask, permute, pseudonym, pseudonymised

COLUMNS = "doc_id long, text string, line int, n_replaced int"


def test_permutation():
    for size in (2, 10, 97, 1000):
        assert sorted(permute(k, size, "t") for k in range(size)) == list(range(size))


def test_formats_and_links(spark):
    card = "401288888888188" + luhn_digit("401288888888188")
    values = {"card": card, "ssn": "123-45-6789", "ip": "10.20.30.40", "date": "1987-02-28", "phone": "+1 (017) 555-7713", "email": "und.34@mail7.example.com"}
    for kind, v in values.items():
        got = pseudonym(kind, v)
        assert got != v and got == pseudonym(kind, v) and pseudonym(kind, got) is not None
        if kind not in ("ip",):
            assert len(got) == len(v) and re.sub(r"\d", "9", got.split("@")[0]).count("9") == re.sub(r"\d", "9", v.split("@")[0]).count("9")
    assert pseudonym("card", card[:-1] + str((int(card[-1]) + 1) % 10)) is None
    assert pseudonym("date", "1987-02-30") is None and pseudonym("ip", "300.1.1.1") is None and pseudonym("ssn", "666-11-1111") is None
    text = "Mail " + ", ".join(values.values()) + "."
    rows = [(1, text, 0, 0), (2, text, 0, 0), (2, text, 0, 0), (3, None, 0, 0), (4, "", 0, 0), (None, "x " * 50_000, None, None)]
    got = pseudonymised(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(rows) and [r.n_replaced for r in got][:3] == [6, 6, 6]
    assert len({r.text for r in got[:3]}) == 1 and not any(v in got[0].text for v in values.values())
    assert mask("nothing here 12 or 2024")[1] == 0
    assert pseudonymised(spark.createDataFrame([], COLUMNS)).count() == 0


def test_license_blocks(spark):
    rows = [(k, f"Some text.\n{t}\nMore.", 0, 0) for k, t in enumerate(TEMPLATES.values())]
    rows += [(90, "You may ask permission of the licensed driver.", 0, 0), (91, None, 0, 0), (92, "", 0, 0), (93, "RELEASED under the MIT license!\nReleased under the MIT License.", 0, 0)]
    got = license_blocks(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.doc_id, r.line, r.license) for r in got if r.doc_id < 90] == [(k, 1, n) for k, n in enumerate(TEMPLATES)]
    assert all(r.differing == 0 and r.saved > 0 for r in got if r.doc_id < 90)
    assert [(r.doc_id, r.line, r.license) for r in got if r.doc_id >= 90] == [(93, 0, "MIT"), (93, 1, "MIT")]
    assert license_blocks(spark.createDataFrame([], COLUMNS)).count() == 0


def test_no_template_is_gated_out(spark):
    texts = ["All rights reserved.", "ALL RIGHTS RESERVED", "Some rights were reserved."]
    rows = [(k, t, 0, 0) for k, t in enumerate(texts)]
    got = license_blocks(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.doc_id, r.license) for r in got] == [(0, "All-Rights-Reserved"), (1, "All-Rights-Reserved")]
    own = {"X": "Zebras may graze here freely."}
    got = license_blocks(spark.createDataFrame([(1, "a\nZebras may graze here freely.", 0, 0)], COLUMNS), templates=own).collect()
    assert [(r.line, r.license) for r in got] == [(1, "X")]


def test_notices_over_lines_and_side_by_side(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
    texts = ["x\n * Licensed under the Apache License,\n * Version 2.0.\n", bsd, "Released under the MIT License. Licensed under CC BY-NC 4.0.",
             "License: " + "Released under the MIT License. " * 2 + "word " * 300 + "All rights reserved. Licensed under the Apache License, Version 2.0."]
    got = license_blocks(spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], COLUMNS)).collect()
    want = [(0, 1, "Apache-2.0"), (1, 0, "BSD-3-Clause"), (2, 0, "MIT"), (2, 0, "CC-BY-NC-4.0"), (3, 0, "MIT"), (3, 0, "MIT"), (3, 0, "All-Rights-Reserved"), (3, 0, "Apache-2.0")]
    assert [(r.doc_id, r.line, r.license) for r in got] == want and all(r.differing == 0 and r.saved > 0 for r in got)
    far = ["Released " + "word " * 9 + "under the MIT " + "word " * 9 + "License."]
    assert license_blocks(spark.createDataFrame([(1, far[0], 0, 0)], COLUMNS)).count() == 0


def test_no_license_under_a_wrong_name(spark):
    gnu = "This work is licensed under the GNU %sPublic License, version %s."
    named = {gnu % ("General ", "2"): "GPL-2.0", gnu % ("General ", "3"): "GPL-3.0", gnu % ("Lesser General ", "3"): "LGPL-3.0", gnu % ("Affero General ", "3"): "AGPL-3.0",
             "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0", "Licensed under CC BY 3.0.": "CC-BY-3.0",
             "Released under the BSD License.": "BSD", "Licensed under the Apache License, Version 1.1.": "Apache-1.1", "Licensed under the Apache license, version 2": "Apache-2.0",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
             "Released in 2019 under the terms of the MIT License": "MIT",
             "Released under the Zlib License.": None, gnu % ("General ", "4"): None, "Licensed under the Apache License, Version 3.0.": None, "Some rights reserved.": None}
    got = license_blocks(spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(named)], COLUMNS)).collect()
    assert [(r.doc_id, r.license) for r in got] == [(k, n) for k, n in enumerate(named.values()) if n]


def test_cards_beside_other_digits():
    card = "4111111111111111"
    spaced = "4111 1111 1111 1111"
    hidden = pseudonym("card", card)
    for text in ("Order 7 %s", "%s 2", "%s 12/27", "%s 123 and", "13 %s 4", "7-%s-123", "No 2024 31 %s 5 6 7 8 9 10 11 12 13 14"):
        assert mask(text % card) == (text % hidden, 1)
    got, n = mask(f"4 {spaced} 12/27")
    assert n == 1 and spaced not in got and got == f"4 {pseudonym('card', spaced)} 12/27"
    mixed = f"1 {card} 1987-02-28 {card} 123-45-6789 {card} 10.20.30.40 {card} 12@example.com"
    want = [hidden, pseudonym("date", "1987-02-28"), hidden, pseudonym("ssn", "123-45-6789"), hidden, pseudonym("ip", "10.20.30.40"), hidden, pseudonym("email", "12@example.com")]
    assert mask(mixed) == ("1 " + " ".join(want), 8)
    assert mask("1 " * 100_000 + card)[0].endswith(hidden)


def test_more_layouts():
    dates = {"28/02/1987": r"\d\d/\d\d/\d{4}", "28.02.1987": r"\d\d\.\d\d\.\d{4}", "02/28/1987": r"\d\d/\d\d/\d{4}", "1987-02-28T10:00": r"\d{4}-\d\d-\d\dT10:00"}
    phones = {"(555) 123-4567": r"\([2-9]\d\d\) \d{3}-\d{4}", "555-123-4567": r"[2-9]\d\d-\d{3}-\d{4}"}
    for value, layout in (dates | phones).items():
        got, n = mask(f"On {value}, or {value}.")
        assert n == 2 and value not in got and re.fullmatch(f"On ({layout}), or \\1\\.", got)
        assert mask(got)[1] == 2
    year, month, day = pseudonym("date", "1987-02-28").split("-")
    assert pseudonym("day", "28.02.1987") == f"{day}.{month}.{year}"
    for text in ("31/02/1987", "28.02.87", "1.28.02.1987", "28/02/1887", "(155) 123-4567", "155-123-4567", "1555-123-4567"):
        assert mask(text) == (text, 0)
    seen = {pseudonym("day", f"{m:02d}/{d:02d}/1990") for m in range(1, 13) for d in range(1, 29)}
    assert len(seen) == 12 * 28
    assert mask("4111111111111111 555-123-4567")[0] == f"{pseudonym('card', '4111111111111111')} {pseudonym('local', '555-123-4567')}"
    for last in ("28/02/1987", "28.02.1987"):
        assert mask(f"4111111111111111 {last}")[0] == f"{pseudonym('card', '4111111111111111')} {pseudonym('day', last)}"


def _every_agreeing_line(lines, templates):
    """Lines in which some run of words agrees with a template: all runs, all templates, no gate and no ranking."""
    from kirana.llm import licenses as lic

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
        return row[-1]

    out = set()
    for at, line in enumerate(lines):
        words = lic._words(line.lower())
        for name, text in templates:
            want = lic._words(text.lower())
            exact = len(want) <= lic.EXACT
            least = len(want) if exact else -(-len(want) * 8 // 10)
            firm = [w for w in want if lic._names(w) or w in lic.NEEDED]
            for i in range(len(words)):
                for j in range(i + least, min(len(words), i + len(want) + (0 if exact else (len(want) + 1) // 2)) + 1):
                    run = words[i:j]
                    if exact:
                        if run == want and not (i and words[i - 1] in lic.DENIALS):
                            out.add((at, name))
                    elif run[0] in want and run[-1] in want and common(firm, run) == len(firm):
                        names = [w for w in run if lic._names(w) and not (lic._year(w) and w not in want)]
                        if names == [w for w in want if lic._names(w)] and common(want, run) >= least:
                            out.add((at, name))
    return out


def test_licenses_by_brute_force(spark):
    from kirana.llm import licenses as lic

    short = [(n, t) for n, t in [*TEMPLATES.items(), *lic.WORDINGS, *[(n, f"SPDX-License-Identifier: {n}") for n in lic.SPDX]] if len(lic._words(t.lower())) <= 16]
    rng = __import__("random").Random(3)
    lines = []
    for _, t in short:
        words = t.split()
        for _ in range(2):
            w = list(words)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.insert(k, rng.choice(["the", "2019", "GNU", "terms", "3"])), lambda: len(w) > 2 and w.pop(k), lambda: w.__setitem__(k, "word")])()
            lines.append(rng.choice(["", "Not ", "Some text, "]) + " ".join(w) + rng.choice(["", " and more mit words"]))
    want = _every_agreeing_line(lines, short)
    got = [(r.doc_id, r.license) for r in license_blocks(spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(lines)], COLUMNS), templates=None).collect()]
    assert set(got) <= want and {k for k, _ in got} == {k for k, _ in want} and len({k for k, _ in want}) > 60


def test_whole_licenses(spark):
    from kirana.llm import licenses as lic

    mit = dict(lic.LONG)["MIT"]
    bsd = {n: t for n, t in lic.LONG if n.startswith("BSD")}
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    named = {mit: "MIT", "x\n" * 3 + mit.replace("Software", "Program"): "MIT", bsd["BSD-2-Clause"]: "BSD-2-Clause", bsd["BSD-3-Clause"].replace("copyright holder", "University"): "BSD-3-Clause",
             gpl: "GPL-2.0", gpl.replace("version 2", "version 3"): "GPL-3.0", gpl.replace("version 2", "version 4"): None, "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
             "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only", "He says all the rights were reserved for the guests.": None, "Not all rights reserved.": None,
             "word " * 3000 + mit + " word" * 3000: "MIT", dict(lic.LONG)["MPL-2.0"]: "MPL-2.0"}
    rows = [(k, t, 0, 0) for k, t in enumerate(named)]
    got = license_blocks(spark.createDataFrame(rows + rows, COLUMNS)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == sorted([(k, n) for k, n in enumerate(named.values()) if n] * 2)
