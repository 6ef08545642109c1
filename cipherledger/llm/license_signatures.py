"""Hand-written signatures of licence texts, notices, headers, package metadata and dual licences.

Each is (name, label, string that every match holds, kind, pattern over lower-case words, a text it is written for).
"""

from __future__ import annotations

#: kind: (priority, weight)
KINDS = {"dual": (88, 0.95), "metadata": (85, 0.9), "notice": (75, 0.9), "text": (45, 0.85), "hint": (35, 0.5)}

SIGNATURES = [
    # ---- permissive texts
    ("mit-grant", "mit", "free of charge", "text", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")"),
    ("mit-rights", "mit", "publish distribute sublicense", "text", r"(?:to )?use copy modify merge publish distribute sublicense and or sell copies of the software", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-notice", "mit", "permission notice", "text", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-title", "mit", "mit license", "notice", r"the mit license(?: mit)? copyright(?: c)? (?:19|20)[0-9]{2}", "The MIT License (MIT)\n\nCopyright (c) 2019 Ann Example"),
    ("mit-no-attribution", "mit-0", "mit no attribution", "notice", r"(?:the )?mit no attribution licen[sc]e", "MIT No Attribution License"),
    ("mit-advertising", "mit-advertising", "advertising", "text", r"shall be included in all copies or substantial portions of the software and in all advertising materials", "shall be included in all copies or substantial portions of the Software and in all advertising materials"),
    ("x11-names", "x11", "x consortium", "text", r"except as contained in this notice the name of the x consortium shall not be used in advertising", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising"),
    ("isc-grant", "isc", "without fee", "text", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("isc-disclaimer", "isc", "author disclaims", "text", r"the software is provided as is and the author disclaims all warranties", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("bsd-source", "bsd", "redistributions of source", "text", r"redistributions of source code must retain the above copyright notice this list of conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd-binary", "bsd", "redistributions in binary", "text", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd-3-endorse", "bsd-3", "endorse or promote", "text", r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|any|the)(?: [^ ]+)? ?contributors may be used to endorse or promote products", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-author", "bsd-3", "endorse or promote", "text", r"the names? of the authors? may not be used to endorse or promote products derived from this software", "The name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-advertising", "bsd-4", "advertising materials", "text", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-header", "bsd", "bsd style", "notice", r"use of this source code is governed by a bsd style licen[sc]e", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-views", "bsd-2-views", "official policies", "text", r"views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies", "The views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd-clear", "bsd-3-clear", "patent rights", "text", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE"),
    ("zlib-origin", "zlib", "misrepresented", "text", r"the origin of this software must not be misrepresented", "The origin of this software must not be misrepresented; you must not claim"),
    ("zlib-altered", "zlib", "altered source versions", "text", r"altered source versions must be plainly marked as such", "Altered source versions must be plainly marked as such"),
    ("boost-header", "bsl-1", "boost software", "notice", r"distributed under the boost software licen[sc]e version 1 0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)"),
    ("boost-text", "bsl-1", "machine executable", "text", r"solely in the form of machine executable object code generated by a source language processor", "solely in the form of machine-executable object code generated by a source language processor"),
    ("ncsa-text", "ncsa", "illinois", "text", r"university of illinois(?: [^ ]+){0,4} nor the names of its contributors may be used to endorse", "nor the University of Illinois at Urbana-Champaign, nor the names of its contributors may be used to endorse"),
    ("postgres-text", "postgresql", "without a written agreement", "text", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("curl-text", "curl", "name of a copyright holder", "text", r"except as contained in this notice the name of a copyright holder shall not be used in advertising", "Except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    ("hpnd-text", "hpnd", "supporting documentation", "text", r"that both that copyright notice and this permission notice appear in supporting documentation", "and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("w3c-notice", "w3c", "w3c", "notice", r"w3c software notice and licen[sc]e", "W3C SOFTWARE NOTICE AND LICENSE"),
    ("unicode-text", "unicode", "unicode", "text", r"unicode data files (?:and any associated documentation|or software)", "a copy of the Unicode data files and any associated documentation"),
    ("ftl-notice", "ftl", "freetype", "notice", r"(?:the )?freetype project licen[sc]e", "The FreeType Project LICENSE"),
    ("ijg-credit", "ijg", "independent jpeg group", "notice", r"this software is based in part on the work of the independent jpeg group", "This software is based in part on the work of the Independent JPEG Group"),
    ("openssl-credit", "openssl", "openssl project", "text", r"this product includes software developed by the openssl project", "This product includes software developed by the OpenSSL Project"),
    ("ssleay-credit", "ssleay", "eric young", "text", r"this product includes cryptographic software written by eric young", "This product includes cryptographic software written by Eric Young"),
    ("beerware", "beerware", "beer", "notice", r"(?:the )?beer ?ware licen[sc]e", "\"THE BEER-WARE LICENSE\" (Revision 42)"),
    ("beerware-text", "beerware", "buy me a beer", "text", r"you can buy me a beer in return", "and you think this stuff is worth it, you can buy me a beer in return."),
    ("wtfpl-text", "wtfpl", "everyone is permitted", "text", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("json-evil", "json", "for good not evil", "text", r"the software shall be used for good not evil", "The Software shall be used for Good, not Evil."),
    ("psf-text", "python-2", "licensor psf", "text", r"this licen[sc]e agreement is between the python software foundation psf and the individual or organization licensee licensor psf", "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") licensor PSF"),
    ("ruby-terms", "ruby", "ruby", "notice", r"(?:under|on) the same terms as ruby(?: itself)?", "You can redistribute it under the same terms as Ruby itself; see the license."),
    ("perl-terms", "perl", "perl", "dual", r"(?:under|on) the same terms as (?:the )?perl(?: ?5)?(?: programming language system)?(?: itself)?", "it under the same terms as Perl itself. See perldoc perlartistic for the license."),
    ("blueoak", "blueoak-1", "blue oak", "notice", r"blue oak model licen[sc]e(?: version)? 1 0 0", "Blue Oak Model License, Version 1.0.0"),
    ("mulan", "mulanpsl-2", "mulan", "notice", r"mulan (?:permissive software licen[sc]e|psl) v2", "licensed under Mulan PSL v2."),
    # ---- Apache
    ("apache-2-header", "apache-2", "except in compliance", "notice", r"licensed under the apache licen[sc]e version 2 0(?: the licen[sc]e)? you may not use this file except in compliance with the licen[sc]e", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."),
    ("apache-2-basis", "apache-2", "conditions of any kind", "text", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2-patent", "apache-2", "patent licen", "text", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent licen[sc]e", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license"),
    ("apache-2-terms", "apache-2", "terms and conditions for use", "text", r"terms and conditions for use reproduction and distribution", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION of the License"),
    ("apache-2-contributors", "apache-2", "contributor licen", "notice", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("apache-1.1-credit", "apache-1.1", "apache software foundation", "text", r"this product includes software developed by the apache software foundation", "This product includes software developed by the Apache Software Foundation"),
    ("apache-1.0-credit", "apache-1.0", "apache group", "text", r"this product includes software developed by the apache group", "This product includes software developed by the Apache Group"),
    ("apache-llvm", "apache-2-llvm", "llvm exception", "notice", r"apache licen[sc]e v?(?:ersion )?2 0 with llvm exceptions?", "Part of the LLVM Project, under the Apache License v2.0 with LLVM Exceptions."),
    # ---- GNU
    ("gpl-2-later", "gpl-2-or-later", "general public", "notice", r"gnu general public licen[sc]e as published by the free software foundation either version 2(?: 0)? of the licen[sc]e or at your option any later version", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3-later", "gpl-3-or-later", "general public", "notice", r"gnu general public licen[sc]e as published by the free software foundation either version 3(?: 0)? of the licen[sc]e or at your option any later version", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2-only", "gpl-2", "general public", "notice", r"gnu general public licen[sc]e version 2(?: only)? as published by the free software foundation", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl-2.1-later", "lgpl-2.1-or-later", "lesser general public", "notice", r"gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3-later", "lgpl-3-or-later", "lesser general public", "notice", r"gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2-later", "lgpl-2-or-later", "library general public", "notice", r"gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e", "GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("agpl-3-later", "agpl-3-or-later", "affero general public", "notice", r"gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-network", "agpl-3", "remotely through a computer network", "text", r"all users interacting with it remotely through a computer network", "must prominently offer all users interacting with it remotely through a computer network an opportunity; see the license"),
    ("gpl-hope", "gpl", "hope that it will be useful", "text", r"distributed in the hope that it will be useful but without any warranty", "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY"),
    ("gpl-copy", "gpl", "received a copy", "text", r"you should have received a copy of the gnu general public licen[sc]e", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl-copy", "lgpl", "received a copy", "text", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("agpl-copy", "agpl-3", "received a copy", "text", r"you should have received a copy of the gnu affero general public licen[sc]e", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("gpl-classpath", "gpl-2-classpath", "classpath", "notice", r"gpl(?: v?2(?: 0)?)? with (?:the )?classpath exception|subject to the classpath exception", "This file is subject to the \"Classpath\" exception as provided in the LICENSE file"),
    ("gpl-gcc", "gpl-3-gcc", "gcc runtime library exception", "notice", r"gcc runtime library exception", "permissions described in the GCC Runtime Library Exception, version 3.1, of the license"),
    ("gpl-linking", "gpl-linking", "special exception", "text", r"as a special exception (?:the )?(?:[^ ]+ ){1,8}permission to link (?:the code|this program|this library)", "As a special exception, the copyright holders give you permission to link this program with other modules, whatever their license"),
    ("gpl-bison", "gpl-bison", "bison", "text", r"part or all of the bison parser skeleton", "you may create a larger work that contains part or all of the Bison parser skeleton under any license"),
    ("gfdl-grant", "gfdl", "free documentation", "notice", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("fsf-unlimited", "fsfullr", "unlimited permission", "text", r"the free software foundation gives unlimited permission to copy and or distribute it", "the Free Software Foundation gives unlimited permission to copy and/or distribute it"),
    ("fsf-all-permissive", "fsfap", "copying and distribution", "text", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty"),
    # ---- weak copyleft and others
    ("mpl-2-header", "mpl-2", "mozilla public", "notice", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-1.1-header", "mpl-1.1", "mozilla public", "notice", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"),
    ("npl-header", "npl-1.1", "netscape public", "notice", r"the contents of this file are subject to the netscape public licen[sc]e version 1 [01]", "The contents of this file are subject to the Netscape Public License Version 1.1"),
    ("mpl-incompatible", "mpl-2-no-copyleft", "incompatible with secondary", "text", r"this source code form is incompatible with secondary licen[sc]es", "This Source Code Form is \"Incompatible With Secondary Licenses\""),
    ("epl-1-header", "epl-1", "eclipse public", "notice", r"(?:accompanying materials )?are made available under the terms of the eclipse public licen[sc]e v1 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("epl-2-header", "epl-2", "eclipse public", "notice", r"(?:accompanying materials )?are made available under the terms of the eclipse public licen[sc]e 2 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cddl-header", "cddl", "development and distribution", "notice", r"subject to the terms of the common development and distribution licen[sc]e", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("cpl-header", "cpl-1", "common public", "notice", r"made available under the terms of the common public licen[sc]e v1 0", "made available under the terms of the Common Public License v1.0"),
    ("eupl-header", "eupl", "eupl", "notice", r"licensed under the eupl(?: version)? (?:v )?1 [12]", "Licensed under the EUPL, Version 1.2 or later"),
    ("artistic-2-text", "artistic-2", "standard version", "text", r"you may distribute verbatim copies of the source form of the standard version of this package", "You may Distribute verbatim copies of the Source form of the Standard Version of this Package under this license"),
    ("ofl-text", "ofl-1.1", "reserved font name", "text", r"with reserved font names?", "Copyright (c) 2012, Ann Example, with Reserved Font Name Sample."),
    ("ofl-header", "ofl-1.1", "open font", "notice", r"this font software is licensed under the sil open font licen[sc]e version 1 1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ms-pl-text", "ms-pl", "microsoft public", "notice", r"subject to the microsoft public licen[sc]e", "This source is subject to the Microsoft Public License."),
    ("qpl", "qpl-1", "q public", "notice", r"the q public licen[sc]e version 1 0", "THE Q PUBLIC LICENSE version 1.0"),
    ("sleepycat", "sleepycat", "accompanying software", "text", r"obtain complete source code for the db software and any accompanying software that uses the db software", "information on how to obtain complete source code for the DB software and any accompanying software that uses the DB software; see license"),
    ("latex", "lppl", "latex project public", "notice", r"distributed and or modified under the conditions of the latex project public licen[sc]e", "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License"),
    ("sspl-notice", "sspl-1", "server side public", "notice", r"it under the terms of the server side public licen[sc]e version 1", "it under the terms of the Server Side Public License, version 1, as published"),
    ("elastic-notice", "elastic-2", "elastic licen", "dual", r"licensed under the elastic licen[sc]e(?: 2 0)? and the server side public licen[sc]e", "licensed under the Elastic License 2.0 and the Server Side Public License, v 1"),
    ("busl-change", "busl-1.1", "change date", "text", r"change date (?:[^ ]+ ){1,6}change licen[sc]e", "Change Date: 2026-01-01\nChange License: Apache License, Version 2.0"),
    ("commons-clause", "commons-clause", "commons clause", "notice", r"commons clause licen[sc]e condition v1 0", "\"Commons Clause\" License Condition v1.0"),
    ("polyform", "polyform", "polyform", "notice", r"polyform (?:noncommercial|small business|shield|strict|internal use|perimeter) licen[sc]e 1 0 [01]", "PolyForm Noncommercial License 1.0.0"),
    # ---- Creative Commons, data, public domain
    ("cc-work", "cc", "creative commons", "notice", r"this work is licensed under (?:a|the) creative commons", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-deed", "cc", "creativecommons", "hint", r"creativecommons org licenses", "See https://creativecommons.org/licenses/ for all."),
    ("cc0-waiver", "cc0", "copyright and related", "text", r"waived all copyright and related or neighbou?ring rights", "has waived all copyright and related or neighboring rights to this work"),
    ("cc0-dedicate", "cc0", "public domain worldwide", "text", r"dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("unlicense-anyone", "unlicense", "anyone is free to", "text", r"anyone is free to copy modify publish use compile sell or distribute this software", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("odbl-notice", "odbl-1", "open database", "notice", r"made available under the open database licen[sc]e", "is made available under the Open Database License"),
    ("openstreetmap", "odbl-1", "openstreetmap contributors", "notice", r"copyright openstreetmap contributors|openstreetmap contributors licen[sc]e", "© Copyright OpenStreetMap contributors"),
    ("ogl", "ogl-uk", "open government", "notice", r"(?:contains public sector information )?licensed under the open government licen[sc]e", "Contains public sector information licensed under the Open Government Licence v3.0."),
    ("us-government", "public-domain", "united states government", "text", r"is a work of the united states government and is (?:therefore )?in the public domain", "This file is a work of the United States Government and is in the public domain"),
    ("no-copyright", "public-domain", "no copyright", "hint", r"no copyright is claimed|no copyright intended", "No copyright is claimed in this text."),
    # ---- dual licences
    ("mit-or-apache", "apache-2-or-mit", "apache", "dual", r"(?:dual )?licensed under (?:either of )?(?:the )?(?:mit(?: licen[sc]e)? (?:or|and) (?:the )?apache(?: licen[sc]e)?(?: version)? 2 0|apache(?: licen[sc]e)?(?: version)? 2 0 (?:or|and) (?:the )?mit(?: licen[sc]e)?)", "dual licensed under the MIT license or the Apache License, Version 2.0"),
    ("mit-or-gpl", "gpl-or-mit", "gpl", "dual", r"dual licensed under the mit (?:or|and) gpl(?: version [23])? licen[sc]es", "Dual licensed under the MIT or GPL Version 2 licenses."),
    ("gpl-or-bsd", "bsd-or-gpl", "gpl", "dual", r"(?:dual bsd gpl|dual gpl bsd)(?: licen[sc]e)?", "MODULE_LICENSE(\"Dual BSD/GPL\");"),
    ("gpl-or-mit-module", "gpl-or-mit", "gpl", "dual", r"(?:dual mit gpl|dual gpl mit)(?: licen[sc]e)?", "MODULE_LICENSE(\"Dual MIT/GPL\");"),
    ("mpl-tri", "gpl-or-lgpl-or-mpl", "mpl 1 1 gpl 2 0 lgpl 2 1", "dual", r"(?:version )?mpl 1 1 gpl 2 0 lgpl 2 1", "***** BEGIN LICENSE BLOCK *****\nVersion: MPL 1.1/GPL 2.0/LGPL 2.1"),
    ("epl-or-edl", "epl-or-edl", "eclipse public", "dual", r"eclipse public licen[sc]e v1 0 and eclipse distribution licen[sc]e v1 0", "under the terms of the Eclipse Public License v1.0 and Eclipse Distribution License v1.0"),
    ("cddl-or-gpl", "cddl-or-gpl-2", "development and distribution", "dual", r"either the gnu general public licen[sc]e version 2 only gpl or the common development and distribution licen[sc]e", "under the terms of either the GNU General Public License Version 2 only (\"GPL\") or the Common Development and Distribution License"),
    ("gpl-or-commercial", "gpl-or-commercial", "commercial licen", "dual", r"commercial licen[sc]e usage licensees holding valid commercial", "Commercial License Usage\nLicensees holding valid commercial licenses may use this file"),
    # ---- package metadata, headers of files
    ("classifier-mit", "mit", "osi approved", "metadata", r"license osi approved mit license", "License :: OSI Approved :: MIT License"),
    ("classifier-apache", "apache-2", "osi approved", "metadata", r"license osi approved apache software license", "License :: OSI Approved :: Apache Software License"),
    ("classifier-bsd", "bsd", "osi approved", "metadata", r"license osi approved bsd license", "License :: OSI Approved :: BSD License"),
    ("classifier-gpl-3", "gpl-3", "osi approved", "metadata", r"license osi approved gnu general public license v3(?: or later)?", "License :: OSI Approved :: GNU General Public License v3 (GPLv3)"),
    ("classifier-gpl-2", "gpl-2", "osi approved", "metadata", r"license osi approved gnu general public license v2(?: or later)?", "License :: OSI Approved :: GNU General Public License v2 (GPLv2)"),
    ("classifier-lgpl", "lgpl", "osi approved", "metadata", r"license osi approved gnu lesser general public license v[23](?: or later)?", "License :: OSI Approved :: GNU Lesser General Public License v3 (LGPLv3)"),
    ("classifier-mpl", "mpl-2", "osi approved", "metadata", r"license osi approved mozilla public license 2 0", "License :: OSI Approved :: Mozilla Public License 2.0 (MPL 2.0)"),
    ("classifier-isc", "isc", "osi approved", "metadata", r"license osi approved isc license", "License :: OSI Approved :: ISC License (ISCL)"),
    ("classifier-psf", "python-2", "osi approved", "metadata", r"license osi approved python software foundation license", "License :: OSI Approved :: Python Software Foundation License"),
    ("classifier-other", "proprietary", "other proprietary", "metadata", r"license other proprietary license", "License :: Other/Proprietary License"),
    ("classifier-public", "public-domain", "license public domain", "metadata", r"license public domain", "License :: Public Domain"),
    ("module-gpl", "gpl", "module license", "metadata", r"module license gpl(?: v2)?", "MODULE_LICENSE(\"GPL v2\");"),
    ("field-mit", "mit", "license mit", "metadata", r"license mit", "\"license\": \"MIT\","),
    ("field-isc", "isc", "license isc", "metadata", r"license isc", "\"license\": \"ISC\","),
    ("field-apache", "apache-2", "license apache 2 0", "metadata", r"license apache 2 0", "license = \"Apache-2.0\""),
    ("field-gpl-3", "gpl-3", "license gpl 3 0", "metadata", r"license gpl 3 0(?: only| or later)?", "license: GPL-3.0-or-later"),
    ("field-gpl-2", "gpl-2", "license gpl 2 0", "metadata", r"license gpl 2 0(?: only| or later)?", "license: GPL-2.0-only"),
    ("field-bsd-3", "bsd-3", "license bsd 3 clause", "metadata", r"license bsd 3 clause", "license = \"BSD-3-Clause\""),
    ("field-bsd-2", "bsd-2", "license bsd 2 clause", "metadata", r"license bsd 2 clause", "license = \"BSD-2-Clause\""),
    ("field-mpl-2", "mpl-2", "license mpl 2 0", "metadata", r"license mpl 2 0", "license = \"MPL-2.0\""),
    ("field-unlicensed", "proprietary", "license unlicensed", "metadata", r"license unlicensed", "\"license\": \"UNLICENSED\""),
    # ---- proprietary
    ("internal-use", "proprietary", "internal use only", "notice", r"(?:confidential )?for internal use only do not (?:re)?distribute", "Confidential. For internal use only. Do not distribute."),
    ("trade-secret", "proprietary", "trade secret", "text", r"protected by trade secret or copyright law", "are protected by trade secret or copyright law."),
    ("no-reproduction", "proprietary", "strictly forbidden", "text", r"(?:dissemination|reproduction|copying)(?: [^ ]+){0,8} is strictly forbidden unless prior written permission", "Reproduction of this material is strictly forbidden unless prior written permission is obtained; copyright"),
    ("unauthorized-copying", "proprietary", "unauthori", "text", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", "Unauthorized copying of this file, via any medium is strictly prohibited"),
    ("eula", "proprietary", "user licen", "notice", r"end user licen[sc]e agreement", "END-USER LICENSE AGREEMENT"),
    ("evaluation", "proprietary", "evaluation", "hint", r"evaluation licen[sc]e only|for evaluation purposes only", "licensed to you for evaluation purposes only"),
    ("academic-use", "academic", "non commercial", "notice", r"for (?:academic|research)(?: and)?(?: research)? non commercial (?:use|purposes) only", "Available for academic and research non-commercial use only"),
]
