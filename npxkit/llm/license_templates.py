"""Notices to look for: name, text, and the words that a match must hold (the licence's name or
version, where another licence's notice differs by these only). Fixed values: the customary wording
of public licences' own notices and of the short licences as a whole. The long licences (Apache,
GPL, LGPL, AGPL, MPL, EPL) are found by the notices their texts ask for, not by their bodies."""

_GNU_REST = (
    "This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {lesser}General Public License for more details."
)
_GNU_LATER = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {lesser}General Public "
    "License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
    "later version. "
) + _GNU_REST
_GNU_ONLY = (
    "This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {lesser}General Public "
    "License version {version} as published by the Free Software Foundation. "
) + _GNU_REST
_GNU_LINE = "This work is licensed under the GNU {lesser}General Public License, version {version}."
_CC_LINE = "This work is licensed under a Creative Commons Attribution{terms} 4.0 International License."

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted{condition}."
)
_ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Fixed values.
TEMPLATES: list[tuple[str, ...]] = [
    ("MIT (line)", "Released under the MIT License.", "MIT"),
    ("Apache-2.0 (line)", "Licensed under the Apache License, Version 2.0.", "Apache 2"),
    ("GPL-2.0 (line)", _GNU_LINE.format(lesser="", version="2"), "2"),
    ("GPL-3.0 (line)", _GNU_LINE.format(lesser="", version="3"), "3"),
    ("LGPL-2.1 (line)", _GNU_LINE.format(lesser="Lesser ", version="2.1"), "Lesser 2 1"),
    ("LGPL-3.0 (line)", _GNU_LINE.format(lesser="Lesser ", version="3"), "Lesser 3"),
    ("AGPL-3.0 (line)", _GNU_LINE.format(lesser="Affero ", version="3"), "Affero 3"),
    ("BSD-3-Clause (line)", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD"),
    ("CC-BY-4.0 (line)", _CC_LINE.format(terms=""), "4"),
    ("CC-BY-SA-4.0 (line)", _CC_LINE.format(terms="-ShareAlike"), "ShareAlike 4"),
    ("CC-BY-ND-4.0 (line)", _CC_LINE.format(terms="-NoDerivatives"), "NoDerivatives 4"),
    ("CC-BY-NC-4.0 (long line)", _CC_LINE.format(terms="-NonCommercial"), "NonCommercial 4"),
    ("CC-BY-NC-SA-4.0 (line)", _CC_LINE.format(terms="-NonCommercial-ShareAlike"), "NonCommercial ShareAlike 4"),
    ("CC-BY-NC-ND-4.0 (line)", _CC_LINE.format(terms="-NonCommercial-NoDerivatives"), "NonCommercial NoDerivatives 4"),
    ("CC-BY-4.0 (short)", "Licensed under CC BY 4.0.", "BY 4"),
    ("CC-BY-SA-4.0 (short)", "Licensed under CC BY-SA 4.0.", "SA 4"),
    ("CC-BY-ND-4.0 (short)", "Licensed under CC BY-ND 4.0.", "ND 4"),
    ("CC-BY-NC-4.0 (line)", "Licensed under CC BY-NC 4.0.", "NC 4"),
    ("CC-BY-NC-SA-4.0 (short)", "Licensed under CC BY-NC-SA 4.0.", "NC SA 4"),
    ("CC-BY-NC-ND-4.0 (short)", "Licensed under CC BY-NC-ND 4.0.", "NC ND 4"),
    (
        "MPL-2.0 (notice)",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla 2",
    ),
    (
        "EPL-2.0 (notice)",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Eclipse 2",
    ),
    (
        "Apache-2.0 (notice)",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
        "Apache 2",
    ),
    ("GPL-2.0-or-later (notice)", _GNU_LATER.format(work="program", lesser="", version="2"), "2"),
    ("GPL-3.0-or-later (notice)", _GNU_LATER.format(work="program", lesser="", version="3"), "3"),
    ("LGPL-2.1-or-later (notice)", _GNU_LATER.format(work="library", lesser="Lesser ", version="2.1"), "Lesser 2 1"),
    ("LGPL-3.0-or-later (notice)", _GNU_LATER.format(work="library", lesser="Lesser ", version="3"), "Lesser 3"),
    ("AGPL-3.0-or-later (notice)", _GNU_LATER.format(work="program", lesser="Affero ", version="3"), "Affero 3"),
    ("GPL-2.0-only (notice)", _GNU_ONLY.format(work="program", lesser="", version="2"), "2"),
    ("GPL-3.0-only (notice)", _GNU_ONLY.format(work="program", lesser="", version="3"), "3"),
    ("LGPL-2.1-only (notice)", _GNU_ONLY.format(work="library", lesser="Lesser ", version="2.1"), "Lesser 2 1"),
    ("AGPL-3.0-only (notice)", _GNU_ONLY.format(work="program", lesser="Affero ", version="3"), "Affero 3"),
    ("MIT (permission)", _MIT_GRANT),
    ("MIT (whole)", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("ISC (permission)", _ISC_GRANT.format(condition=_ISC_CONDITION)),
    ("ISC (whole)", f"{_ISC_GRANT.format(condition=_ISC_CONDITION)} {_ISC_WARRANTY}"),
    ("0BSD (whole)", f"{_ISC_GRANT.format(condition='')} {_ISC_WARRANTY}"),
    ("BSD (conditions)", _BSD_CONDITIONS),
    ("BSD-2-Clause (whole)", _BSD_CONDITIONS + _BSD_WARRANTY),
    ("BSD-3-Clause (whole)", _BSD_CONDITIONS + _BSD_NAMES + _BSD_WARRANTY, "Neither endorse"),
    (
        "Zlib (whole)",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    (
        "BSL-1.0 (grant)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "Unlicense (dedication)",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    (
        "CC0-1.0 (dedication)",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
]
