"""Licence texts as published, wrapped and not."""

import os
import re

import pytest

from flowtab.llm import licenses

SYSTEM = "/usr/share/common-licenses"
MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Copyright (c) 2024, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = (
    BSD2
    + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def gnu(what, name, version, colon):
    end = ", either" if colon == ":" else "; either"
    return f"""This {what} is free software{colon} you can redistribute it and/or modify
it under the terms of the {name} as published by
the Free Software Foundation{end} version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{name} for more details."""


CASES = [
    (MIT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (ISC, "ISC"), (UNLICENSE, "Unlicense"), (APACHE_HEADER, "Apache-2.0"), (MPL_HEADER, "MPL-2.0"),
    (gnu("program", "GNU General Public License", "2", ";"), "GPL-2.0"), (gnu("program", "GNU General Public License", "3", ":"), "GPL-3.0"),
    (gnu("library", "GNU Lesser General Public License", "2.1", ";"), "LGPL-2.1"), (gnu("library", "GNU Lesser General Public License", "3", ":"), "LGPL-3.0"),
    (gnu("program", "GNU Affero General Public License", "3", ":"), "AGPL-3.0"),
    ("The code is licensed under the MIT license.", "MIT"), ("This work is licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Text under the terms of the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License.", "CC-BY-4.0"),
    ("Released under the GNU General Public License v3 only", "GPL-3.0"), ("Nothing is said of a licence here, nor of any MIT.", ""), ("", ""),
]


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    return [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]


def commented(text):
    return "\n".join(f" * {line}".rstrip() for line in text.split("\n"))


def test_published_texts(spark):
    """Wrapped as published, unwrapped, with other line ends, as a comment, and within prose: all are recognised."""
    forms = [lambda t: t, lambda t: re.sub(r"(?<!\n)\n(?!\n)", " ", t), lambda t: t.replace("\n", "\r\n"), commented, lambda t: f"Some prose stands before it.\n\n{t}\n\nAnd after it."]
    got = scanned(spark, [form(t) for t, _ in CASES for form in forms])
    assert got == [name for _, name in CASES for _ in forms]


def test_whole_texts_of_the_system(spark):
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    there = {k: v for k, v in names.items() if os.path.exists(f"{SYSTEM}/{k}")}
    if not there:
        pytest.skip("no licence texts on this system")
    got = scanned(spark, [open(f"{SYSTEM}/{k}", encoding="utf-8").read() for k in there])
    assert all(want in g.split(",") for g, want in zip(got, there.values(), strict=True)), dict(zip(there, got, strict=True))


def test_names_and_order(spark):
    assert len(licenses.SENTENCES) < 200 and all(re.search(licenses._ANCHOR, s) for s in licenses.SENTENCES.values())
    grant, notice = MIT.split("\n\n")[2], MIT.split("\n\n")[3]
    got = scanned(spark, [f"{grant}\n\nOther words.\n\n{notice}", f"{notice}\n\n{grant}", "x\n\nReleased  under the MIT license.\n\nAll rights reserved."])
    assert got == ["MIT", "", "MIT"]


def test_tags_and_copyright_lines(spark):
    """A file's tag names its licence; beside a permissive one a copyright line's reservation is no finding, alone or beside others it is."""
    tags = ["MIT", "Apache-2.0", "GPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "LGPL-3.0", "MPL-2.0", "Zlib", "EPL-2.0", "0BSD", "CC-BY-3.0"]
    got = scanned(spark, [f"// SPDX-License-Identifier: {t}\n// Copyright 2020 X. All rights reserved.\nint main();\n" for t in tags])
    assert got == [t if t in licenses.PERMISSIVE else ",".join(sorted(["All-Rights-Reserved", t])) for t in tags]
    header = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file.\n\nCopyright 2020 X. All rights reserved."
    df = spark.createDataFrame([(1, header), (2, "Copyright 2020 X. All rights reserved."), (3, "# SPDX-License-Identifier: GPL-2.0-only\n")], "doc_id bigint, text string")
    assert [(r.licenses, r.permissive) for r in licenses.scan(df).orderBy("doc_id").collect()] == [("Apache-2.0", True), ("All-Rights-Reserved", False), ("GPL-2.0", False)]
