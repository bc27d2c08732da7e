"""Licence scans by sentence rules, natively.

A text is cut into sentences, sentences are normalised, and known ones become identifiers: those of the table of sentences,
and short notices ("licensed under the terms of ...") with one of the names of a licence. A licence rule is an
ordered sequence of identifiers; it matches where they follow each other in the text with no other known sentence
between them. Everything is one projection over the documents: no row is exploded and nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Licence sentences by identifier.
SENTENCES: dict[str, list[str]] = {
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "mit-keep": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    ],
    "mit-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT.",
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "x11-consortium": ["IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "isc-liability": [
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "IN NO EVENT SHALL ISC BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "apache-grant": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-condition": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-terms": ["See the License for the specific language governing permissions and limitations under the License."],
    "apache-title": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-definition": ["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."],
    "gpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl3-only-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-only-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl2-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "lgpl-details": ["See the GNU Lesser General Public License for more details.", "See the GNU Library General Public License for more details."],
    "agpl-details": ["See the GNU Affero General Public License for more details."],
    "gpl-copying": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl2-preamble": ["By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."],
    "agpl3-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "lgpl3-preamble": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions, and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd-as-is": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "bsd-liability": [
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl11-subject": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");"],
    "epl2-available": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."],
    "epl1-available": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "zlib-altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "zlib-notice": ["This notice may not be removed or altered from any source distribution."],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0-dedicated": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "wtfpl-term": ["You just DO WHAT THE FUCK YOU WANT TO."],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "hpnd-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.", "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation."],
    "ofl-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "ofl-goals": ["The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects, to support the font creation efforts of academic and linguistic communities, and to provide a free and open framework in which fonts may be shared and improved in partnership with others."],
    "artistic2-preamble": ["This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."],
    "beerware-retain": ["As long as you retain this notice you can do whatever you want with this stuff."],
    "beerware-beer": ["If we meet some day, and you think this stuff is worth it, you can buy me a beer in return."],
    "python-psf": ["This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software (\"Python\") in source or binary form and its associated documentation."],
    "cddl-subject": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")."],
    "upl-grant": ["Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the \"Software\"), free of charge and under any and all copyright rights in the Software, and any and all patent rights owned or freely licensable by each licensor hereunder covering either (i) the unmodified Software as contributed to or provided by such licensor, or (ii) the Larger Works (as defined below), to deal in both"],
    "reserved": ["All rights reserved."],
}

#: Licences that notices name, by identifier, with the names besides the identifier.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "Expat", "MIT/Expat"],
    "MIT-0": ["MIT No Attribution", "MIT-0"],
    "ISC": ["ISC"],
    "0BSD": ["Zero-Clause BSD", "0BSD", "BSD Zero Clause"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD"],
    "BSD-4-Clause": ["BSD 4-Clause", "4-Clause BSD", "Original BSD"],
    "Apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache 2"],
    "Apache-1.1": ["Apache License 1.1", "Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License Version 1.1", "MPL 1.1"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public Licence v1.2", "EUPL 1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0", "CDDL"],
    "CPL-1.0": ["Common Public License 1.0", "Common Public License Version 1.0"],
    "Zlib": ["zlib", "zlib/libpng"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software"],
    "BUSL-1.1": ["Business Source License 1.1"],
    "SSPL-1.0": ["Server Side Public License", "Server Side Public License, Version 1", "SSPL"],
    "Elastic-2.0": ["Elastic License 2.0", "Elastic License v2"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public"],
    "PostgreSQL": ["PostgreSQL"],
    "OFL-1.1": ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1", "Open Font License 1.1"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic 2.0"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic 1.0"],
    "NCSA": ["University of Illinois/NCSA Open Source", "NCSA"],
    "MS-PL": ["Microsoft Public", "Ms-PL"],
    "MS-RL": ["Microsoft Reciprocal", "Ms-RL"],
    "PSF-2.0": ["Python Software Foundation", "PSF", "PSF License Version 2"],
    "Ruby": ["Ruby"],
    "PHP-3.01": ["PHP License 3.01", "PHP License, version 3.01"],
    "Vim": ["Vim"],
    "Beerware": ["Beerware", "Beer-ware"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License", "ODbL", "ODbL 1.0"],
    "ODC-By-1.0": ["Open Data Commons Attribution License", "ODC-By", "ODC-By 1.0"],
    "PDDL-1.0": ["Open Data Commons Public Domain Dedication and License", "PDDL"],
    "GFDL-1.3": ["GNU Free Documentation License", "GNU Free Documentation License 1.3", "GNU Free Documentation License, Version 1.3"],
    "UPL-1.0": ["Universal Permissive License 1.0", "Universal Permissive License v 1.0"],
    "AFL-3.0": ["Academic Free License 3.0", "Academic Free License version 3.0"],
    "OSL-3.0": ["Open Software License 3.0", "Open Software License version 3.0"],
    "JSON": ["JSON"],
    "X11": ["X11"],
    "HPND": ["Historical Permission Notice and Disclaimer"],
    "MulanPSL-2.0": ["Mulan PSL v2", "Mulan Permissive Software License, Version 2"],
}


def _gnu_names() -> dict[str, list[str]]:
    """GNU licences, as this version only or with any later one."""
    kinds = [("GPL", "General Public License", ["2", "3"]), ("LGPL", "Lesser General Public License", ["2.1", "3"]), ("AGPL", "Affero General Public License", ["3"])]
    out = {}
    for (short, name, versions), later in itertools.product(kinds, (False, True)):
        for v in versions:
            tails = [" or later", " or any later version", ", or (at your option) any later version"] if later else ["", " only"]
            heads = [f"GNU {name}, version {v}", f"GNU {name} version {v}", f"GNU {name} v{v}", f"GNU {name} v{v}.0", f"GNU {short} v{v}", f"GNU {short}v{v}", f"{short}v{v}", f"{short} v{v}", f"{short}-{v}.0", f"{short} {v}.0", f"{short} {v}", f"{short} version {v}"]
            out[f"{short}-{v}{'' if '.' in v else '.0'}-{'or-later' if later else 'only'}"] = [h + t for h in heads for t in tails]
    return out


def _creative_commons_names() -> dict[str, list[str]]:
    """The Creative Commons licences by their parts and versions."""
    words = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    out = {}
    for parts, version in itertools.product(("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"), ("2.5", "3.0", "4.0")):
        long = "Creative Commons " + "-".join(words[x] for x in parts.split("-")) + f" {version}"
        out[f"CC-{parts}-{version}"] = [f"CC {parts} {version}", f"CC-{parts}-{version}", long, f"{long} International", f"{long} Unported", f"{long} Generic"]
    return out


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Ordered rules: licence, and the identifiers that must follow each other. Notices are added by name.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is", "mit-liability"]),
    ("MIT-0", ["mit0-grant", "mit-as-is", "mit-liability"]),
    ("X11", ["mit-grant", "mit-keep", "mit-as-is", "x11-consortium"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("Apache-2.0", ["apache-grant", "apache-condition", "apache-copy", "apache-as-is", "apache-terms"]),
    ("Apache-2.0", ["apache-title", "apache-definition"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-only", ["gpl3-only-free", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-only", ["gpl2-only-free", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("LGPL-2.0-or-later", ["lgpl2-free", "gpl-hope", "gpl-implied", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-hope", "gpl-implied", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "gpl-implied", "lgpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "gpl-implied", "agpl-details"]),
    ("GPL-3.0-only", ["gpl-copying", "gpl3-preamble"]),
    ("GPL-2.0-only", ["gpl-copying", "gpl2-preamble"]),
    ("AGPL-3.0-only", ["gpl-copying", "agpl3-preamble"]),
    ("LGPL-3.0-only", ["gpl-copying", "lgpl3-preamble"]),
    ("BSD-4-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", ["bsd-redistribute", "bsd-source"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("MPL-1.1", ["mpl11-subject"]),
    ("EPL-2.0", ["epl2-available"]),
    ("EPL-1.0", ["epl1-available"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("WTFPL", ["wtfpl-title"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("HPND", ["hpnd-grant"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("OFL-1.1", ["ofl-goals"]),
    ("Artistic-2.0", ["artistic2-preamble"]),
    ("Beerware", ["beerware-retain", "beerware-beer"]),
    ("PSF-2.0", ["python-psf"]),
    ("CDDL-1.0", ["cddl-subject"]),
    ("UPL-1.0", ["upl-grant"]),
]

NOTICES: dict[str, list[str]] = NAMES | _gnu_names() | _creative_commons_names()
RULES += [(name, [f"{name}-notice"]) for name in NOTICES] + [("All-Rights-Reserved", ["reserved"])]

#: What is done to a text before it is cut: comment signs at the ends of lines go, and every sentence end followed by white space
#: becomes a line end. Written so that both engines read the patterns alike; {1} is the first group in either's way of naming it.
STEPS = [
    ("(?m)^[ \\t]*(?:[#*;%!>|]+|/[/*]+|\\(\\*|--+|-|<!--|(?:REM|rem|dnl|Rem)[ \\t])[ \\t]*[#*/]*[ \\t]*", ""),
    ("(?m)[ \\t]*(?:\\*+/|-->|\\*\\)|[#*|]+)[ \\t]*\\r?$", ""),
    ("([0-9])\\+", "{1} or later"),
    ("([.!?:;])[ \\t\\r]+", "{1}\n"),
]


def _known() -> dict[str, str]:
    """Identifiers by normalised sentence; notices are those that begin with `licensed under`, with or without `license` at their end."""
    out = {normal(s): key for key, forms in SENTENCES.items() for s in forms}
    for licence, names in NOTICES.items():
        for name in dict.fromkeys(normal(x) for x in [*names, licence]):
            for form in (name, f"{name} license", f"{name} licence"):
                out.setdefault(f"licensed under {form}", f"{licence}-notice")
    return out


KNOWN: dict[str, str] = _known()

#: How a notice may begin; the normal form is `licensed under`.
HEADS = "(?:(?:this|the)[ \\n](?:project|software|work|code|library|package|program|file|repository|module|document|material|content)[ \\n](?:is|are)[ \\n])?(?:released|licensed|distributed|available|published|provided)[ \\n]under[ \\n](?:the[ \\n]terms[ \\n]of[ \\n])?(?:(?:the|a)[ \\n])?"


def _branches(sentences: list[list[str]]) -> str:
    """A pattern of alternative word sequences that reads common beginnings once; words are divided by a blank or a line end."""
    after: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            after.setdefault(words[0], []).append(words[1:])
    parts = []
    for word, rests in sorted(after.items()):
        run = [word]
        while len({tuple(r[:1]) for r in rests}) == 1 and rests[0]:  # the words that all share
            run.append(rests[0][0])
            rests = [r[1:] for r in rests]
        further = [r for r in rests if r]
        tail = "" if not further else f"(?:[ \\n]{_branches(further)})" + ("?" if len(further) < len(rests) else "")
        parts.append("[ \\n]".join(run) + tail)
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


#: A known sentence is one piece or several in a row: lines may be wrapped anywhere, and a sentence may have a colon or an abbreviation inside.
_NOTICE_IDS = {f"{x}-notice" for x in NOTICES}
_NOTICED, _WHOLE = ([s.split() for s in KNOWN if KNOWN[s] in _NOTICE_IDS and s.startswith("licensed under ") == noticed or not noticed and KNOWN[s] not in _NOTICE_IDS] for noticed in (True, False))
SPANS = "(?m)^(?:" + HEADS + _branches([s[2:] for s in _NOTICED]) + "|" + _branches(_WHOLE) + ")$"

#: What a rule's last sentence must not be followed by: the terms of a licence after "All rights reserved.", and the sentences by which longer rules go on.
_OPENS = sorted({rule[0] for _, rule in RULES if rule[0] not in _NOTICE_IDS} - {"reserved"})
NOT_BEFORE: dict[str, list[str]] = {"bsd-source": ["bsd-binary"], "bsd-binary": ["bsd-endorse", "bsd-advert"], "reserved": _OPENS}


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences in their order."""
    for pattern, to in STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to.replace("{1}", "$1")))
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    bare = F.regexp_replace(F.lower(text), F.lit("[^a-z0-9\\n]+"), F.lit(" "))
    pieces = F.trim(F.regexp_replace(bare, F.lit(" ?\\n ?"), F.lit("\n")))
    found = F.transform(F.regexp_extract_all(pieces, F.lit(SPANS), F.lit(0)), lambda s: F.translate(s, "\n", " "))
    return F.transform(found, lambda s: F.coalesce(known[s], known[F.regexp_replace(s, F.lit(f"^{HEADS}"), F.lit("licensed under "))]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, n_licenses) of every row.

    sentence_ids are the known sentences' identifiers in order, separated by blanks; licenses are the names of the rules that match,
    in the rules' order, each once, separated by commas. All-Rights-Reserved right before a licence's terms does not count. Null and
    empty texts have none: 0 and empty strings. Repeated rows get the same values, an empty table gives an empty result.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
    line = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    rows = ids.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), line.alias("line"))
    found = F.when(F.col("n_sentences") > 0, F.array_distinct(F.array_compact(F.array(*(F.when(_follows(rule), F.lit(name)) for name, rule in RULES))))).otherwise(F.array().cast("array<string>"))
    out = rows.select("doc_id", "n_sentences", "sentence_ids", found.alias("found"))
    return out.select("doc_id", "n_sentences", "sentence_ids", F.array_join("found", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"))


def _follows(rule: list[str]) -> Column:
    """Whether a rule's identifiers follow each other in `line`, and nothing goes on that must not."""
    parts = " " + " ".join(rule) + " "
    if rule[-1] not in NOT_BEFORE:
        return F.contains("line", F.lit(parts))
    return F.rlike("line", F.lit(f"{parts}(?!(?:{'|'.join(NOT_BEFORE[rule[-1]])}) )"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rules in SQL; sentences are looked up by joins, rules by the positions of their first identifier."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "coalesce(text, '')"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, '{pattern}', {quote(to.replace('{1}', chr(92) + '1'))}, 'g')"
    known = ", ".join(f"({quote(s)}, {quote(k)})" for s, k in KNOWN.items())
    listed = lambda xs: f"[{', '.join(map(quote, xs))}]::VARCHAR[]"
    rules = ", ".join(f"({i}, {quote(name)}, {listed(rule)}, {listed(NOT_BEFORE.get(rule[-1], []))})" for i, (name, rule) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(rank, license, parts, not_before) AS (VALUES {rules}),
t AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')) AS pieces FROM documents),
m AS (SELECT r, list_transform(regexp_extract_all(pieces, '{SPANS}'), lambda s: replace(s, chr(10), ' ')) AS hits FROM t),
u AS (SELECT r, unnest(hits) AS s, unnest(range(len(hits))) AS pos FROM m),
w AS (SELECT r, pos, coalesce(a.id, b.id) AS id FROM u LEFT JOIN known a ON a.sentence = s LEFT JOIN known b ON b.sentence = regexp_replace(s, '^{HEADS}', 'licensed under ')),
i AS (SELECT r, list(id ORDER BY pos) AS ids FROM w GROUP BY r),
p AS (SELECT i.r, rank, license FROM i JOIN rules ON list_contains(ids, parts[1])
      WHERE len(list_filter(range(1, len(ids) + 1), lambda x: ids[x:x + len(parts) - 1] = parts AND NOT list_contains(not_before, coalesce(ids[x + len(parts)], '')))) > 0),
d AS (SELECT r, license, min(rank) AS rank FROM p GROUP BY r, license),
l AS (SELECT r, string_agg(license, ',' ORDER BY rank) AS licenses, count(*) AS n FROM d GROUP BY r)
SELECT t.doc_id, coalesce(len(ids), 0) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses
FROM t LEFT JOIN i USING (r) LEFT JOIN l USING (r)
"""


OP10_SQL = _sql()
