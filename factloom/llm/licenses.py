"""License scans by canonical digests of entire texts (operator 2), by DataFrame functions only.

A text is put into canonical form: lower case, copyright lines dropped (of a notice that a licence follows in its line, the notice alone), equivalent spellings made one, and everything that
is neither letter nor digit a single space. The SHA-256 of that form is joined to the digests of known licence texts in the
same form. The known texts are a short literal list, and of long licences the list has the digests of their whole canonical forms; it is broadcast.

Null and empty texts, and texts without letters and digits, have an empty form and no licence. Repeated rows are judged
alike; an empty table gives none; other columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of well-known public licences and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(" THIS SOFTWARE IS PROVIDED", " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED", 1)
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
# Identifiers and names of licences, and the sentences that refer to one by its name.
NAMES = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "Zlib": ("zlib License",), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "Unlicense": ("Unlicense",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3"), "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"), "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0 Universal"), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
SENTENCES = ("Licensed under the {}.", "Licensed under {}.", "Licensed under a {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "This project is licensed under the {}.", "{}")
TITLED = {"MIT": MIT, "ISC": ISC, "0BSD": ZERO_BSD, "Zlib": ZLIB, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "BSL-1.0": BOOST, "Unlicense": UNLICENSE, "Apache-2.0": APACHE, "MPL-2.0": MPL}
GNU_NAMES = {"GPL-2.0": ("GNU General Public License", "2"), "GPL-3.0": ("GNU General Public License", "3"), "LGPL-2.1": ("GNU Lesser General Public License", "2.1"), "LGPL-3.0": ("GNU Lesser General Public License", "3"), "AGPL-3.0": ("GNU Affero General Public License", "3")}


def known() -> dict[str, list[str]]:
    """Texts of each licence: its wording alone, under its names, and sentences that say nothing else than its name."""
    out = {}
    for k, names in NAMES.items():
        body = TITLED.get(k) or (GNU.format(name=GNU_NAMES[k][0], version=GNU_NAMES[k][1]) if k in GNU_NAMES else None)
        whole = [body, *(f"{n} {body}" for n in names), *(f"The {n} ({k}) {body}" for n in names)] if body else []
        out[k] = [*whole, *(x.format(n) for n in names for x in SENTENCES), f"SPDX-License-Identifier: {k}"]
    return out


KNOWN = known()
# SHA-256 of the canonical forms of whole licences as they are published.
DIGESTS = {
    "Apache-2.0": "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25", "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2", "BSD-3-Clause": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b", "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d", "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
}
# Spellings taken as equal.
SPELLINGS = {"licence": "license", "sub license": "sublicense", "non infringement": "noninfringement", "merchantibility": "merchantability", "favour": "favor", "acknowledgement": "acknowledgment", "organisation": "organization", "copyright owner": "copyright holder", "https ": "http "}
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*"
RESERVED = r"(^|\n)[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*"
OTHER = r"[^\p{L}\p{N}]+"
# How licences begin that follow a notice in its line.
OPENINGS = ("permission is hereby granted", "permission to use", "redistribution and use in source", "this software is provided", "this is free and unencumbered", "licensed under the apache", "this source code form", "this program is free software", "this library is free software")
ONE_LINE = rf"(^|\n)[^\p{{L}}\p{{N}}\n]*(?:copyright|\(c\)|©)[^\n]*?(?:[0-9]{{4}}|\(c\)|©)[^\n]*?(?:all rights reserved[^\p{{L}}\p{{N}}\n]*)?({'|'.join(OPENINGS)})"


def canonical(text: Column) -> Column:
    """The canonical form."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ONE_LINE, "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT, "\n"), RESERVED, "\n")
    t = F.trim(F.regexp_replace(t, OTHER, " "))
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def scan(docs: DataFrame, texts_by_id: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (of the canonical form), digest, license_id (null: no known licence) of each row."""
    spark = docs.sparkSession
    texts = spark.createDataFrame([(k, t) for k, ts in (texts_by_id or KNOWN).items() for t in ts], "license_id string, text string")
    whole = spark.createDataFrame([(v, k) for k, v in (DIGESTS if texts_by_id is None else {}).items()], "digest string, license_id string")
    digests = texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").unionByName(whole).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    own = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("form"))
    own = own.select("doc_id", F.length("form").cast("long").alias("n_chars"), F.sha2("form", 256).alias("digest"))
    return own.join(F.broadcast(digests), "digest", "left").select("doc_id", "n_chars", "digest", "license_id")


BACK = r"\1\2"


def _sql(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(lower(coalesce({text}, '')), {q(ONE_LINE)}, {q(BACK)}, 'g')"
    t = f"regexp_replace(regexp_replace({t}, {q(COPYRIGHT)}, chr(10), 'g'), {q(RESERVED)}, chr(10), 'g')"
    t = f"trim(regexp_replace({t}, {q(OTHER)}, ' ', 'g'))"
    for a, b in SPELLINGS.items():
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


_VALUES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, ts in KNOWN.items() for t in ts)
_WHOLE = ", ".join(f"('{v}', '{k}')" for k, v in DIGESTS.items())
SQL = f"""
WITH w AS (SELECT sha256({_sql("text")}) AS digest, license_id FROM (VALUES {_VALUES}) AS v(license_id, text) UNION ALL SELECT * FROM (VALUES {_WHOLE}) AS v(digest, license_id)), k AS (SELECT digest, min(license_id) AS license_id FROM w GROUP BY 1),
d AS (SELECT doc_id, {_sql("text")} AS form FROM documents)
SELECT doc_id, length(form) AS n_chars, sha256(form) AS digest, license_id FROM d LEFT JOIN k ON k.digest = sha256(form)
"""
