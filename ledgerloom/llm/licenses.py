"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

Words are lower-cased runs of letters and digits. For every template the best passage of a
text is sought: one that starts and ends with a bigram of the template and spans at
most ``longest`` bigrams. Size bounds prune: a Dice coefficient of t or more
needs at least t / (2 - t) of the template's bigrams, and at most (2 - t) / t times as many in
the passage. The templates are a fixed table of a few kilobytes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

# Public licence notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-2.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Library General Public License for more details.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
THRESHOLD = 0.8
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_LETTER = (_PLAIN >= 128) | ((_PLAIN >= 97) & (_PLAIN <= 122)) | ((_PLAIN >= 48) & (_PLAIN <= 57))
_STEP = np.uint64(0x9FB21C651E98DF25)


def bigrams(data, offsets):
    """(document, word position, hash) of each bigram of normalised words."""
    data = _PLAIN[data]
    docs, starts, ends = K.spans(_LETTER[data], offsets)
    words = K.span_hashes(data, starts, ends)
    if len(words) < 2:
        return docs[:0], starts[:0], words[:0]
    same = np.flatnonzero(docs[:-1] == docs[1:])
    return docs[same], same, K.mix(words[same] * _STEP + words[same + 1])


def compiled(templates: dict[str, str]):
    """(name, bigram counts, number of bigrams) of each template, by number of bigrams and name."""
    out = []
    for name, text in templates.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        _, _, h = bigrams(raw, np.array([0, len(raw)]))
        out.append((name, Counter(h.tolist()), len(h)))
    return out


def best_passage(at, hashes, counts, size, threshold):
    """(Dice, first position) of the best passage between hits, or None under the threshold.

    ``at`` and ``hashes``: the template's bigrams in the text, in order.
    """
    longest = int(size * (2 - threshold) / threshold)
    need = threshold / (2 - threshold) * size
    best = None
    for i in range(len(at)):
        if len(at) - i < need:
            break
        seen: Counter = Counter()
        inter = 0
        for j in range(i, len(at)):
            span = at[j] - at[i] + 1
            if span > longest:
                break
            h = hashes[j]
            seen[h] += 1
            inter += seen[h] <= counts[h]
            dice = 2 * inter / (size + span)
            if dice >= threshold and (best is None or dice > best[0]):
                best = (dice, int(at[i]))
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice, licenses and n_licenses of every row's whole text.

    license is the template with the highest coefficient (equal ones: the longer, then the
    earlier in the table), licenses all of threshold or more, by coefficient. No match,
    null or empty text: null, 0.0 and an empty list.
    """
    table = compiled(TEMPLATES if templates is None else templates)

    @K.tidy
    def run(batches):
        known = np.unique(np.concatenate([np.fromiter(c, np.uint64, len(c)) for _, c, _ in table] or [np.zeros(0, np.uint64)]))
        gate = np.zeros(1 << 16, bool)
        gate[(known >> np.uint64(48)).astype(np.int64)] = True
        for part, data, offsets in K.chunks(batches, "text"):
            docs_of, at, h = bigrams(data, offsets)
            maybe = np.flatnonzero(gate[(h >> np.uint64(48)).astype(np.int64)])
            hit = maybe[np.isin(h[maybe], known)]
            cuts = np.searchsorted(docs_of[hit], np.arange(len(offsets)))
            names, scores, all_names = [], [], []
            for d in range(len(offsets) - 1):
                here = hit[cuts[d] : cuts[d + 1]]
                found = []
                if len(here):
                    pos, hashes = at[here].tolist(), h[here].tolist()
                    for k, (name, counts, size) in enumerate(table):
                        own = [i for i, x in enumerate(hashes) if x in counts]
                        if len(own) >= threshold / (2 - threshold) * size:
                            got = best_passage([pos[i] for i in own], [hashes[i] for i in own], counts, size, threshold)
                            if got:
                                found.append((-got[0], -size, k, name))
                found.sort()
                names.append(found[0][3] if found else None)
                scores.append(-found[0][0] if found else 0.0)
                all_names.append([f[3] for f in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(all_names, pa.list_(pa.string())), pa.array([len(x) for x in all_names], pa.int64())], ["doc_id", "license", "dice", "licenses", "n_licenses"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, license string, dice double, licenses array<string>, n_licenses long")


def plain_words(text: str | None) -> list[str]:
    """The words that the scan compares, for reading and tests."""
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
