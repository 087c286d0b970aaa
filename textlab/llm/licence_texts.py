"""Texts of licences and of the notices that name them."""

from __future__ import annotations

import re
from pathlib import Path

# Published licence texts, without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_LEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

# (identifier, text): whole licences and headers.
LICENCES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_LEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_LEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_LEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_LEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-3.0-or-later", _GPL_HEADER),
]

# The advice on how to apply a licence follows this line; many copies end before or with it.
_END = re.compile(r"^ *END OF TERMS AND CONDITIONS *$", re.M)


def full_texts() -> list[tuple[str, str]]:
    """(identifier, text) of the whole published licences in the folder ``licence_data``,
    also without the advice after their terms."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_data").glob("*.txt")):
        text = path.read_text("utf-8")
        out.append((path.stem, text))
        if end := _END.search(text):
            out += [(path.stem, text[: end.end()]), (path.stem, text[: end.start()])]
    return out


# (identifier, line): notices that stand for a licence on a line of their own.
NOTICES = [
    (name, f"{lead} {title}.")
    for name, titles in [
        ("MIT", ["the MIT License"]),
        ("ISC", ["the ISC License"]),
        ("BSD-2-Clause", ["the BSD 2-Clause License"]),
        ("BSD-3-Clause", ["the BSD 3-Clause License"]),
        ("Zlib", ["the zlib License"]),
        ("Apache-2.0", ["the Apache License, Version 2.0", "the Apache License 2.0"]),
        ("GPL-2.0-only", ["the GNU General Public License, version 2", "GPLv2"]),
        ("GPL-3.0-only", ["the GNU General Public License, version 3", "GPLv3"]),
        ("LGPL-3.0-only", ["the GNU Lesser General Public License, version 3", "LGPLv3"]),
        ("AGPL-3.0-only", ["the GNU Affero General Public License, version 3", "AGPLv3"]),
        ("MPL-2.0", ["the Mozilla Public License, version 2.0", "MPL 2.0"]),
        ("CC0-1.0", ["CC0 1.0"]),
        ("CC-BY-4.0", ["CC BY 4.0"]),
        ("CC-BY-SA-4.0", ["CC BY-SA 4.0"]),
        ("CC-BY-NC-4.0", ["CC BY-NC 4.0"]),
        ("CC-BY-ND-4.0", ["CC BY-ND 4.0"]),
        ("CC-BY-NC-SA-4.0", ["CC BY-NC-SA 4.0"]),
    ]
    for title in titles
    for lead in ("Licensed under", "Released under", "This work is licensed under",
                 "This software is licensed under", "Distributed under")
]

# Spellings that count as equal, (variant, standard form).
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
