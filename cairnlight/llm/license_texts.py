"""Notices and characteristic passages of common licences, by family."""

NOTICES = [
    "Licensed under the {n}.", "Licensed under {n}.", "Released under the {n}.", "Released under {n}.", "This work is licensed under the {n}.", "This work is licensed under a {n}.",
    "This project is distributed under the terms of the {n}.", "This software is made available under the {n}.", "Published under the {n}, see the LICENSE file.",
    "You may use this file under the terms of the {n}.", "The code is free to use under {n}.", "License: {n}", "Subject to the {n}", "{n}",
]

NAMES = {
    "mit": ["MIT License", "MIT licence", "The MIT License (MIT)", "Expat License"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License version 2.0", "Apache-2.0 license"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL version 3 or later"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL version 2 only"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 3", "LGPL", "GNU Library General Public License"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "Affero GPL version 3"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD license"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "isc": ["ISC License", "ISC licence"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"],
    "unlicense": ["Unlicense", "The Unlicense"],
}

SPDX = {
    "mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "gpl-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "gpl-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"],
    "agpl-3.0": ["AGPL-3.0-only"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "mpl-2.0": ["MPL-2.0"], "isc": ["ISC"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc0": ["CC0-1.0"], "unlicense": ["Unlicense"],
}

#: Paragraphs of the licences' own texts and of their usual headers. What the
#: GNU licences share, and doesn't tell which of them it is, is family "gnu".
PASSAGES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "gnu": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the following terms: Attribution. You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "cc-by-nc": ["You may not use the material for commercial purposes. You must give appropriate credit.", "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "all-rights-reserved": ["All rights reserved.", "Copyright 2024 Example Corp. All rights reserved.", "No part of this work may be reproduced without written permission of the publisher. All rights reserved.", "Copyright (c) 2019 the authors, all rights reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
}

#: Text about licences that belongs to no family.
OTHER = [
    "Licensed under the Acme Community License.", "Released under the Beerware License.", "This work is licensed under the Artistic License.", "Distributed under a custom commercial license agreement.",
    "His driver's license expired last year.", "The city licensed three new taxis under the old rules.", "A license is required to sell food in the market.", "She released the report under pressure from the public.",
    "The copyright of the painting was disputed.", "Version 2 of the software was released in May.", "The general public was not allowed in.", "They reserved a table and all seats.", "Free software was handed out at the fair.",
    "License: to be decided", "The foundation published a document about conditions.", "Permission to park is granted on Sundays.", "Under the terms of the contract the work is done.", "This project is distributed to all partners.",
]
