"""A hundred headers and notices as they stand in files, each with the labels that a reader gives it."""

from __future__ import annotations

from mudline.llm import license_scan

#: Labels, then texts separated by bars: all of the labels must be found.
HEADERS = """
mit: Licensed under the MIT License.|This project is licensed under the terms of the MIT license.|Released under MIT.|License: MIT|// SPDX-License-Identifier: MIT|MIT licensed project by J. Doe|See the MIT License for details|@license MIT License (see LICENSE)|distributed under the Expat license
apache-2: Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.|SPDX-License-Identifier: Apache-2.0|Apache 2.0|licensed under Apache License 2.0|http://www.apache.org/licenses/LICENSE-2.0|The Apache Software License, Version 2.0|Unless required by applicable law or agreed to in writing, software distributed under the License|License: Apache 2.0|released under the Apache 2 license
mit apache-2: Dual licensed MIT / Apache-2.0|SPDX-License-Identifier: MIT OR Apache-2.0|licensed under either of the MIT license or Apache License, Version 2.0 at your option
bsd: Redistribution and use in source and binary forms, with or without modification, are permitted|Released under the BSD license|Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.|This is available under a BSD style license|License: BSD
bsd-3-clause: SPDX-License-Identifier: BSD-3-Clause|the 3-Clause BSD License|Modified BSD License|Neither the name of the copyright holder nor the names of its contributors may be used to endorse
bsd-2-clause: SPDX-License-Identifier: BSD-2-Clause|Simplified BSD License|FreeBSD BSD 2-clause license
gpl-2: GNU General Public License as published by the Free Software Foundation; either version 2 of the License|SPDX-License-Identifier: GPL-2.0-only|GPLv2|licensed under the GPL v2 or later|GNU GPL version 2|under the terms of the GNU General Public License version 2
gpl-3: GNU General Public License as published by the Free Software Foundation, either version 3|SPDX-License-Identifier: GPL-3.0-only|GPL-3.0|released under the GPLv3|https://www.gnu.org/licenses/gpl-3.0.html|General Public License v3
gpl: You should have received a copy of the GNU General Public License along with this program.|available under the GNU GPL|This is free software under the GNU General Public License.|covered under the GPL
gpl-2 classpath-exception: SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0
lgpl-2.1: GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1|LGPL v2.1|SPDX-License-Identifier: LGPL-2.1|https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html
lgpl-3: GNU Lesser General Public License v3|LGPLv3|SPDX-License-Identifier: LGPL-3.0
lgpl: released under the LGPL|distributed under the GNU LGPL|You should have received a copy of the GNU Lesser General Public License
agpl-3: GNU Affero General Public License version 3|AGPLv3|https://www.gnu.org/licenses/agpl-3.0.en.html|SPDX-License-Identifier: AGPL-3.0
mpl-2: This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.|MPL 2.0|SPDX-License-Identifier: MPL-2.0|http://mozilla.org/MPL/2.0/
mpl: covered by the Mozilla Public License
epl-1: made available under the terms of the Eclipse Public License v1.0|https://www.eclipse.org/legal/epl-v10.html
epl-2: SPDX-License-Identifier: EPL-2.0|Eclipse Public License 2.0
cddl-1: the terms of the Common Development and Distribution License (CDDL)|CDDL 1.0
isc: Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted|SPDX-License-Identifier: ISC|ISC License
zlib: zlib License|Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.|SPDX-License-Identifier: Zlib
boost-1: Distributed under the Boost Software License, Version 1.0.|BSL-1.0
unlicense: This is free and unencumbered software released into the public domain.|https://unlicense.org
cc0: SPDX-License-Identifier: CC0-1.0|CC0 1.0 Universal|https://creativecommons.org/publicdomain/zero/1.0/
cc-by: Creative Commons Attribution 4.0 International|CC BY 4.0|https://creativecommons.org/licenses/by/4.0/|published under a CC BY license
cc-by-sa: Creative Commons Attribution-ShareAlike 3.0 Unported|CC BY-SA 4.0
cc-by-nc: CC BY-NC 4.0|Creative Commons Attribution-NonCommercial 4.0
cc-by-nc-nd: Creative Commons Attribution-NonCommercial-NoDerivatives 4.0
cc-by-nc-sa: https://creativecommons.org/licenses/by-nc-sa/4.0/
artistic-2: Artistic License 2.0
perl: under the same terms as Perl itself
public-domain: This file is in the public domain.|released to the public domain
ofl-1.1: This Font Software is licensed under the SIL Open Font License, Version 1.1.
wtfpl: DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
python-2: Python Software Foundation License Version 2
bsl-1.1: Business Source License 1.1
sspl-1: Server Side Public License
all-rights-reserved: Copyright 2020 Example Corp. All Rights Reserved.
proprietary: Unauthorized copying of this file, via any medium is strictly prohibited
confidential: Proprietary and confidential
latex: LaTeX Project Public License
ncsa: University of Illinois/NCSA Open Source License
upl-1: Universal Permissive License v 1.0
osl-3: Open Software License 3.0
apsl-2: Apple Public Source License 2.0
polyform-nc: PolyForm Noncommercial License 1.0.0
"""
#: Sentences that name no license as theirs.
NOTHING = ["not released under the GPL v3", "This work is no longer distributed under the BSD license", "This license is incompatible with the GPL", "unlike the Apache License, ours is short", "ich komme mit dem Hund", "the general public was licensed to enter", "a boost to the open database of the library", "plain prose about permission and fair use"]


def labels(text):
    return {m["label"] for m in license_scan.scan(text)[1]}


def test_recall_on_headers():
    cases = [(set(line.split(": ", 1)[0].split()), text) for line in HEADERS.strip().split("\n") for text in line.split(": ", 1)[1].split("|")]
    missed = [(want, text, labels(text)) for want, text in cases if not want <= labels(text)]
    assert len(cases) >= 100 and len(missed) <= 0.05 * len(cases), missed


def test_denials_and_prose_have_no_label():
    assert {t: labels(t) for t in NOTHING if labels(t)} == {}
    # a base phrase stays, as the contract says, and what follows a denial counts
    assert labels("not licensed under the MIT license") == {"mit"} and labels("unlike the GPL, this is MIT licensed") == {"mit"}
