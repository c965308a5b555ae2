"""License scans on texts as they stand in files; the expected names are written here by hand, not made from the rules."""

import pytest

from scorewright.llm import license_rules as L

BSD3 = """Copyright (c) 2010, Google Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of {} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License version 2 as
 * published by the Free Software Foundation.
"""
ISC = """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
CASES = [
    (BSD3.format("Google Inc."), "bsd-3-clause"),
    (BSD3.format("the University of California, Berkeley"), "bsd-3-clause"),
    (BSD3.format("the copyright holder"), "bsd-3-clause"),
    (BSD3.split("   * Neither")[0], "bsd-2-clause"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}", "mit or apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0 */", "gpl-2.0-only"),
    ("# SPDX-License-Identifier: GPL-2.0+\nimport os", "gpl-2.0-or-later"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause", "gpl-2.0-only with linux-syscall-note or bsd-3-clause"),
    ("SPDX-License-Identifier: Apache-2.0 AND MIT", "apache-2.0 and mit"),
    ("x SPDX-License-Identifier: MIT", None),  # not a line of its own
    ("SPDX-License-Identifier: LicenseRef-Own", None),
    ("SPDX-License-Identifier: MIT\n\nmore text follows here.", "mit"),
    (GPL2, "gpl-2.0-only"),
    (GPL2.replace("program", "file").replace("version 2", "version 3"), "gpl-3.0-only"),
    (ISC, "isc"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "mit or apache-2.0"),
    ("The name of the licence is unknown. It is free software.", None),
    ("Neither the name of " + "very " * 40 + "long holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", None),
    (None, None),
    ("", None),
]


@pytest.mark.parametrize("times", [1, 3])
def test_texts_of_files(spark, times):
    rows = [(k, (t or "") * times if t else t, "x") for k, (t, _) in enumerate(CASES)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    if times == 1:
        assert {k: got[k].license for k in got} == {k: want for k, (_, want) in enumerate(CASES)}
    assert got[4].licenses == (["mit or apache-2.0", "mit", "apache-2.0"] if times == 1 else got[4].licenses)


def test_a_very_long_text(spark):
    text = "words of no license at all.\n" * 100_000 + BSD3.format("Foo GmbH") + "more of the same software, published.\n" * 50_000
    r = L.scan(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    assert [x.license for x in r] == ["bsd-3-clause"] * 3
