"""Licence wording with marked-up regions, by label. <<beginOptional>>...<<endOptional>> may be left out; <<var;name="...";match="...">> stands for one word or more that match."""

from __future__ import annotations

_HOLDER = '<<beginOptional>>Copyright <<beginOptional>>(c) <<endOptional>><<var;name="year";match="[0-9]+">> <<var;name="holder";match=".+">> <<endOptional>>'

TEMPLATES = [
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License")<<endOptional>>'),
    ("apache-2.0", "<<beginOptional>>under the terms of the <<endOptional>>Apache License<<beginOptional>>,<<endOptional>> 2.0"),
    (
        "apache-2.0-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>><<var;name="scheme";match="https?">>://www.apache.org/licenses/LICENSE-2.0<<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    ("mit-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software<<beginOptional>> and associated documentation files (the '
        '"Software")<<endOptional>>, to deal in the Software without restriction'),
    (
        "mit-full",
        """<<beginOptional>>The MIT License <<beginOptional>>(MIT) <<endOptional>><<endOptional>>"""
        + _HOLDER
        + """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("mit-notice", "<<beginOptional>>This software is <<endOptional>><<beginOptional>>Released <<endOptional>>under the MIT License"),
    (
        "isc",
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("gpl-3.0", "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>>, either<<endOptional>> version "
        "3<<beginOptional>> of the License<<endOptional>>"),
    ("gpl-2.0", "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>>, either<<endOptional>> version "
        "2<<beginOptional>> of the License<<endOptional>>"),
    (
        "gpl-notice",
        """<<var;name="program";match=".+">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser <<endOptional>>
        <<beginOptional>>Affero <<endOptional>>General Public License as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>> version <<var;name="version";match="[0-9]+">> of the
        License<<beginOptional>>, or (at your option) any later version<<endOptional>>. <<var;name="program";match=".+">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License for more
        details.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        <<var;name="scheme";match="https?">>://mozilla.org/MPL/2.0/.""",
    ),
    ("cc-by-nc-4.0", "CC BY-NC<<beginOptional>>-<<endOptional>> 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution<<beginOptional>>-<<endOptional>>NonCommercial 4.0<<beginOptional>> International<<endOptional>><<beginOptional>> License<<endOptional>>"),
    ("cc-by-4.0", "<<beginOptional>>licensed under a <<endOptional>>Creative Commons Attribution 4.0<<beginOptional>> International<<endOptional>><<beginOptional>> License<<endOptional>>"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd-full",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3. <<endOptional>>
        Neither the name of <<var;name="owner";match=".+">> may be used to endorse or promote products derived from this software without specific prior written permission. <<endOptional>>THIS SOFTWARE IS
        PROVIDED BY <<var;name="by";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
        OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("spdx", 'SPDX-License-Identifier: <<var;name="id";match="[a-z0-9]+">>'),
    ("copyright", 'Copyright <<beginOptional>>(c) <<endOptional>><<var;name="year";match="[12][0-9]{3}">> <<var;name="holder";match="[^0-9]+">> All rights reserved'),
    ("all-rights-reserved", "All rights reserved"),
]
