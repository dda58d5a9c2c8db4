import textwrap

import pytest

from weirgauge.llm.licences import scan_licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NOTICES = [
    (MIT, "MIT", "mit-grant,mit-condition,as-is-mit"),
    (GPL.format(":", 3), "GPL-3.0-or-later", "gpl-redistribute-3,gpl-hope"),
    (GPL.format(";", 2), "GPL-2.0-or-later", "gpl-redistribute-2,gpl-hope"),
    (APACHE, "Apache-2.0", "apache-under-the-license,apache-compliance,apache-copy,apache-basis"),
    (BSD, "BSD-2-Clause", "bsd-redistribution,bsd-source,bsd-binary"),
]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [75, 40, 10_000])
def test_standard_notices(make_docs, prefix, width):
    rows, want = [], []
    for at, (notice, licence, ids) in enumerate(NOTICES):
        lines = ["Copyright 2020 Somebody", ""]
        for part in notice.split("\n\n"):
            lines += [*textwrap.wrap(part.strip(), width), ""]
        rows.append((at, "\n".join((prefix + x).rstrip() for x in lines) + "\ncode | more\n", "en", "a"))
        want.append((at, licence, ids, ids.count(",") + 1, 2))
    assert sorted(tuple(r) for r in scan_licences(make_docs(rows)).collect()) == want


def test_only_whole_sentences(make_docs):
    rows = [(1, "This project is\nlicensed under the MIT license.", "en", "a"), (2, "not released\nunder the MIT license.", "en", "a"),
            (3, "Released under\nthe MIT license for all", "en", "a"), (4, "a|b.\n\nReleased under the | MIT\r\nlicense", "en", "a")]
    got = sorted((r["doc_id"], r["sentence_ids"], r["first_sentence"]) for r in scan_licences(make_docs(rows)).collect())
    assert got == [(1, "mit-project", 0), (4, "mit-notice", 1)]
