"""Grants, headers and notices of public licenses that the scan looks for, and the words that tell those of one family apart.

A license is known by the part that grants it; disclaimers of warranty are alike in many and aren't part of a template.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A text; words that a find must hold, and words that it mustn't, in lower case."""

    text: str
    needs: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()


_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


def _cc(name: str, version: str = "4.0") -> str:
    return f"This work is licensed under a Creative Commons {name} {version} International License"


_GNU_BARS = ("lesser", "library", "affero")
_CC_BARS = ("noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd")


def _other(*own: str) -> tuple[str, ...]:
    return tuple(w for w in _CC_BARS if w not in own)


TEMPLATES: dict[str, Template] = {
    "Apache-2.0-notice": Template("Licensed under the Apache License, Version 2.0", ("apache", "2")),
    "Apache-2.0-header": Template(
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        ("apache", "2"),
    ),
    "MIT-notice": Template("Released under the MIT License", ("mit",)),
    "MIT": Template(
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": Template(_PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies.", ("appear",)),
    "0BSD": Template(_PERMISSION + '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES', (), ("appear",)),
    "BSD-2-Clause": Template(_BSD_CONDITIONS, (), ("endorse",)),
    "BSD-3-Clause": Template(
        _BSD_CONDITIONS + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse",)
    ),
    "BSL-1.0": Template(
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        ("transmit",),
    ),
    "Zlib": Template(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": Template(
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("unencumbered",),
    ),
    "GPL-2.0-notice": Template("This work is licensed under the GNU General Public License, version 2", ("gnu", "2"), _GNU_BARS),
    "GPL-3.0-notice": Template("This work is licensed under the GNU General Public License, version 3", ("gnu", "3"), _GNU_BARS),
    "LGPL-notice": Template("This work is licensed under the GNU Lesser General Public License, version", ("gnu", "lesser")),
    "AGPL-3.0-notice": Template("This work is licensed under the GNU Affero General Public License, version 3", ("gnu", "affero")),
    "GPL-2.0-header": Template(_gnu("General Public License", "2"), ("gnu", "2"), (*_GNU_BARS, "3")),
    "GPL-3.0-header": Template(_gnu("General Public License", "3"), ("gnu", "3"), (*_GNU_BARS, "2")),
    "LGPL-2.1-header": Template(_gnu("Lesser General Public License", "2.1"), ("lesser", "2"), ("affero",)),
    "LGPL-3.0-header": Template(_gnu("Lesser General Public License", "3"), ("lesser", "3"), ("affero",)),
    "AGPL-3.0-header": Template(_gnu("Affero General Public License", "3"), ("affero", "3"), ("lesser",)),
    "MPL-2.0-header": Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla", "2")),
    "EPL-2.0-header": Template("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", ("eclipse", "2")),
    "CC0-1.0": Template("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived",)),
    "CC-BY-4.0": Template(_cc("Attribution"), ("attribution", "4"), _CC_BARS),
    "CC-BY-SA-4.0": Template(_cc("Attribution-ShareAlike"), ("sharealike", "4"), _other("sharealike")),
    "CC-BY-ND-4.0": Template(_cc("Attribution-NoDerivatives"), ("noderivatives", "4"), _other("noderivatives")),
    "CC-BY-NC-4.0": Template(_cc("Attribution-NonCommercial"), ("noncommercial", "4"), _other("noncommercial")),
    "CC-BY-NC-SA-4.0": Template(_cc("Attribution-NonCommercial-ShareAlike"), ("noncommercial", "sharealike", "4"), _other("noncommercial", "sharealike")),
    "CC-BY-NC-ND-4.0": Template(_cc("Attribution-NonCommercial-NoDerivatives"), ("noncommercial", "noderivatives", "4"), _other("noncommercial", "noderivatives")),
    "CC-BY-4.0-notice": Template("Licensed under CC BY 4.0", ("cc", "by", "4"), _CC_BARS),
    "CC-BY-SA-4.0-notice": Template("Licensed under CC BY-SA 4.0", ("cc", "sa", "4"), _other("sa")),
    "CC-BY-NC-4.0-notice": Template("Licensed under CC BY-NC 4.0", ("cc", "nc", "4"), _other("nc")),
    "CC-BY-ND-4.0-notice": Template("Licensed under CC BY-ND 4.0", ("cc", "nd", "4"), _other("nd")),
    "CC-BY-NC-SA-4.0-notice": Template("Licensed under CC BY-NC-SA 4.0", ("cc", "nc", "sa", "4"), _other("nc", "sa")),
    "CC-BY-NC-ND-4.0-notice": Template("Licensed under CC BY-NC-ND 4.0", ("cc", "nc", "nd", "4"), _other("nc", "nd")),
}
