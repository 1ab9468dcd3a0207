"""License texts that scans look for (fixed values).

Each is the text or notice its owners ask users to attach, without the lines that name a
holder or a year, or one of the short lines that files carry instead. ``telling`` are phrases
that tell a version or variant apart from its neighbours: all must stand in a block, whatever
share of the text it holds. ``excluding`` are phrases of neighbours that say more: none may stand in a block or near it.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """Label, phrases that must stand in the block, text, phrases that must not."""

    label: str
    telling: tuple[str, ...]
    text: str
    excluding: tuple[str, ...] = ()


#: Texts that several licenses share.
MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
GNU_NOTICE = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the
License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""

#: What the MIT license asks for and its variant without conditions leaves out; what another variant adds; the clauses that tell BSD licenses apart.
MIT_ASKS, NOT_EVIL = "the above copyright notice and this permission notice shall be included", "shall be used for good not evil"
NAMES, ADVERTISING = "neither the name of", "all advertising materials mentioning features"
#: Short lines: label, words after "SPDX-License-Identifier:"; label, version and name of GNU licenses.
IDENTIFIERS = (("mit", "MIT"), ("apache-2", "Apache-2.0"), ("isc", "ISC"), ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl-3", "LGPL-3.0"), ("agpl-3", "AGPL-3.0"), ("mpl-2", "MPL-2.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("unlicense", "Unlicense"))
GNU_LINES = (("gpl-2", "2", "General Public License"), ("gpl-3", "3", "General Public License"), ("lgpl-3", "3", "Lesser General Public License"), ("agpl-3", "3", "Affero General Public License"))

TEMPLATES = (
    Template("mit", (MIT_ASKS,), MIT_GRANT + MIT_DISCLAIMER, (NOT_EVIL,)),
    Template("mit", ("permission is hereby granted free of charge", "deal in the software without restriction", MIT_ASKS), MIT_GRANT, (NOT_EVIL,)),
    Template("isc", ("permission to use copy modify and or distribute this software", "this permission notice appear in all copies"), """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    Template("apache-2", ("version 2 0",), """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    Template("bsd-2", ("redistributions in binary form must reproduce",), BSD_CONDITIONS + BSD_DISCLAIMER, (NAMES, ADVERTISING)),
    Template("bsd-3", (NAMES,), BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER, (ADVERTISING,)),
    Template("gpl-2", ("gnu general public license", "version 2 of"), GNU_NOTICE.format(name="General Public License", version=2)),
    Template("gpl-3", ("gnu general public license", "version 3 of"), GNU_NOTICE.format(name="General Public License", version=3)),
    Template("lgpl-3", ("gnu lesser general public license", "version 3 of"), GNU_NOTICE.format(name="Lesser General Public License", version=3)),
    Template("agpl-3", ("gnu affero general public license", "version 3 of"), GNU_NOTICE.format(name="Affero General Public License", version=3)),
    Template("mpl-2", ("mozilla public license v 2 0",), """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    Template("cc-by-nc", ("noncommercial 4 0",), """
        This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit
        http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""),
    Template("cc-by", ("attribution 4 0",), """
        This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
        http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""),
    Template("unlicense", ("released into the public domain",), """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    *(Template(label, (f"identifier {name}".lower().replace("-", " ").replace(".", " "),), f"SPDX-License-Identifier: {name}", ("identifier mit 0",) if name == "MIT" else ()) for label, name in IDENTIFIERS),
    *(Template(label, (f"gnu {name.lower()} version {n}",), f"licensed under the GNU {name} version {n}") for label, n, name in GNU_LINES),
    Template("apache-2", ("apache license version 2 0",), "Licensed under the Apache License, Version 2.0"),
    Template("cc-by-nc", ("cc by nc 4 0",), "released under CC BY-NC 4.0"),
)
