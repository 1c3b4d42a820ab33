"""Known license texts and notices (fixed values), and the one-line notices that follow from names.

``NAMES`` has the SPDX identifier, class and usual names of common licenses; ``TEMPLATES`` are the sentences in which
sources state a license; ``TEXTS`` are whole texts and the notices that licenses ask to be put at the head of files.
"""

NAMES = [
    ("MIT", "permissive", ["MIT License", "MIT licence", "Expat License"]),
    ("ISC", "permissive", ["ISC License"]),
    ("BSD-2-Clause", "permissive", ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause License"]),
    ("BSD-3-Clause", "permissive", ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"]),
    ("Apache-2.0", "permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0"]),
    ("Zlib", "permissive", ["zlib License"]),
    ("BSL-1.0", "permissive", ["Boost Software License, Version 1.0", "Boost Software License 1.0"]),
    ("Unlicense", "public-domain", ["Unlicense"]),
    ("0BSD", "permissive", ["BSD Zero Clause License", "Zero-Clause BSD License"]),
    ("CC0-1.0", "public-domain", ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"]),
    ("CC-BY-4.0", "attribution", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", "copyleft", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", "noncommercial", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-ND-4.0", "noderivatives", ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    ("GPL-2.0-only", "copyleft", ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPLv2"]),
    ("GPL-3.0-only", "copyleft", ["GNU General Public License, version 3", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"]),
    ("LGPL-2.1-only", "weak-copyleft", ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"]),
    ("LGPL-3.0-only", "weak-copyleft", ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"]),
    ("AGPL-3.0-only", "copyleft", ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"]),
    ("MPL-2.0", "weak-copyleft", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"]),
    ("EPL-2.0", "weak-copyleft", ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"]),
    ("WTFPL", "permissive", ["Do What The Fuck You Want To Public License"]),
]

TEMPLATES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "Available under the {}.",
    "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "This project is licensed under the {}.",
    "This software is licensed under the {}.", "This software is released under the {}.", "This file is licensed under the {}.", "This code is licensed under the {}.",
]

_WARRANTY_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_WARRANTY_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY_MIT}'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "{2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GPL = "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{version}.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.\n\nYou should have received a copy of the GNU {kind}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."


def _numbered(text: str) -> list[str]:
    return [text.format("1.", "2.", "3."), text.format("*", "*", "*")]


def _gpl(spdx: str, cls: str, kind: str, version: str) -> list[tuple[str, str, str]]:
    either = [(f"{spdx}-or-later", f"; either version {version} of the License, or (at your option) any later version"), (f"{spdx}-or-later", f", either version {version} of the License, or (at your option) any later version"), (f"{spdx}-only", f", version {version} of the License"), (f"{spdx}-only", f", version {version}")]
    return [(name, cls, _GPL.format(colon=colon, kind=kind, version=v)) for name, v in either for colon in (":", ";")]


TEXTS = [
    ("MIT", "permissive", _MIT),
    ("MIT", "permissive", f"MIT License\n\n{_MIT}"),
    ("MIT", "permissive", f"The MIT License (MIT)\n\n{_MIT}"),
    ("MIT", "permissive", f"The MIT License\n\n{_MIT}"),
    ("MIT-0", "permissive", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n{_WARRANTY_MIT}'),
    ("ISC", "permissive", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_WARRANTY_ISC}"),
    ("ISC", "permissive", f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_WARRANTY_ISC}"),
    ("0BSD", "permissive", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_WARRANTY_ISC}"),
    *[("BSD-2-Clause", "permissive", head + t + "\n\n" + _WARRANTY_BSD) for head in ("", "BSD 2-Clause License\n\n") for t in _numbered(_BSD_TWO)],
    *[("BSD-3-Clause", "permissive", head + t + "\n\n" + _WARRANTY_BSD) for head in ("", "BSD 3-Clause License\n\n") for t in _numbered(_BSD_TWO + "\n\n" + _BSD_THIRD)],
    ("Zlib", "permissive", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "permissive", 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "public-domain", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'),
    ("WTFPL", "permissive", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "weak-copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "weak-copyleft", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *_gpl("GPL-2.0", "copyleft", "", "2"), *_gpl("GPL-3.0", "copyleft", "", "3"),
    *_gpl("LGPL-2.1", "weak-copyleft", "Lesser ", "2.1"), *_gpl("LGPL-3.0", "weak-copyleft", "Lesser ", "3"), *_gpl("AGPL-3.0", "copyleft", "Affero ", "3"),
    ("LicenseRef-All-Rights-Reserved", "proprietary", "All rights reserved."),
    ("LicenseRef-All-Rights-Reserved", "proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
]


def known() -> list[tuple[str, str, str]]:
    """``(license, class, text)``: the texts, the notices by name and template, and the SPDX tags."""
    by_name = [(spdx, cls, t.format(n)) for spdx, cls, names in NAMES for n in names for t in TEMPLATES]
    tags = [(spdx, cls, f"{mark}SPDX-License-Identifier: {spdx}") for spdx, cls, _ in NAMES for mark in ("", "License: ")]
    later = [(f"{s[:-5]}-or-later", cls, f"SPDX-License-Identifier: {s[:-5]}-or-later") for s, cls, _ in NAMES if s.endswith("-only")]
    return [*TEXTS, *by_name, *tags, *later]
