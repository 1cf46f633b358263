"""Signatures of licenses: patterns over lower-case words joined by single spaces.

Fixed values, written by hand: names of licenses, their identifiers and addresses,
and phrases of their texts and headers. Punctuation has become spaces, so an address
reads "www apache org licenses license 2 0". A rule's keyword is part of each of its
matches.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A signature: its label, priority (0 to 100), keyword and pattern over words joined by single spaces."""

    name: str
    label: str
    priority: int
    keyword: str
    pattern: str


#: Phrases of license texts, of the notices put at the head of files, and of grants: label, keyword, pattern.
TEXTS: tuple[tuple[str, str, str], ...] = (
    # MIT and its kin
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "shall be included", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranties of merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "liable for any claim", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "mit style", r"mit style licen[sc]e that can be found in the licen[sc]e file"),
    ("mit", " mit", r"see licen[sc]e (?:file )?(?:for )?mit"),
    ("mit", "mit licensed", r"(?:is|are|code is) mit licensed"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("mit-advertising", "endorse", r"except as contained in this notice the name of the author may not be used to endorse"),
    ("mit-feh", "materials", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated materials"),
    ("mit-cmu", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", "permission to use", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("hpnd", "representations about the suitability", r"makes no representations about the suitability of this software for any purpose"),
    ("ntp", "hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    # ISC
    ("isc", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", "tortious action", r"resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("0bsd", "disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    # BSD
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "must retain", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:the |its |\S+ ){1,8}(?:may|nor) (?:the names of )?(?:its |the )?(?:contributors |be )?(?:may )?(?:be )?used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse or promote", r"the name of the (?:author|company|copyright holder) (?:may|must) not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "copyright holders and contributors", r"this software is provided by (?:the )?copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "regents", r"this software is provided by the regents and contributors as is"),
    ("bsd-2-clause", "the author", r"this software is provided by the author as is and any express or implied warranties"),
    ("bsd", "procurement of substitute", r"damages including but not limited to procurement of substitute goods or services"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("bsd", "bsd style", r"bsd style licen[sc]e that can be found in the licen[sc]e file"),
    ("bsd-2-clause-views", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-source-code", "bsd licensed", r"(?:is|are|code is) bsd licensed"),
    # Apache
    ("apache-2.0", "may not use this file", r"licensed under the apache licen[sc]e version 2 0 (?:the licen[sc]e )?you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2.0", "terms and conditions", r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-2.0", "apache software foundation asf", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", "each contributor hereby grants", r"subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[sc]e"),
    ("apache-2.0", "derivative works", r"you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group"),
    # GNU
    ("gpl-2.0-or-later", "either version 2 of", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", "either version 3 of", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0-only", "version 2", r"under the terms of the gnu general public licen[sc]e (?:version 2 as published by the free software foundation|as published by the free software foundation version 2)(?: of the licen[sc]e)?"),
    ("gpl", "for more details", r"see the gnu general public licen[sc]e for more details"),
    ("gpl", "along with this", r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|file|library)"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "without even the implied warranty", r"in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-2.0", "version 2 june 1991", r"gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-3.0", "version 3 29 june 2007", r"gnu general public licen[sc]e version 3 29 june 2007"),
    ("gpl-1.0", "version 1 february 1989", r"gnu general public licen[sc]e version 1 february 1989"),
    ("gpl-3.0", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("gpl-2.0", "guarantee your freedom", r"the gnu general public licen[sc]e is intended to guarantee your freedom to share and change free software"),
    ("gpl", "absolutely no warranty", r"comes with absolutely no warranty this is free software and you are welcome to redistribute it under certain conditions"),
    ("gpl-3.0", "tivoization", r"(?:anti )?tivoization"),
    ("gpl-linking-exception", "special exception", r"as a special exception the copyright holders (?:of this library )?give (?:you )?permission to link"),
    ("gpl-classpath", "classpath exception", r"(?:gnu )?classpath exception"),
    ("gcc-exception", "gcc runtime", r"gcc runtime library exception"),
    ("lgpl-2.1-or-later", "either version 2 1 of", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version"),
    ("lgpl-3.0-or-later", "either version 3 of", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1", "version 2 1 february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl", "lesser general public", r"see the gnu lesser general public licen[sc]e for more details"),
    ("lgpl-2.0", "library general public", r"under the terms of the gnu library general public licen[sc]e as published by the free software foundation"),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl-3.0-or-later", "affero general public", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("agpl-3.0", "version 3 19 november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("agpl-3.0", "affero general public", r"see the gnu affero general public licen[sc]e for more details"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl-no-invariants", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-dual", "dual licensed", r"dual licensed under (?:the )?(?:mit|bsd|apache|mpl) and gpl"),
    # Mozilla, Eclipse and other corporate ones
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-2.0", "mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "rights and limitations", r"see the licen[sc]e for the specific language governing rights and limitations under the licen[sc]e"),
    ("mpl-2.0", "incompatible with secondary", r"this source code form is incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e"),
    ("npl-1.1", "netscape public", r"netscape public licen[sc]e(?: version 1 [01])?"),
    ("epl-1.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0"),
    ("epl", "this eclipse public", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e agreement"),
    ("edl-1.0", "eclipse distribution", r"eclipse distribution licen[sc]e(?: v 1 0)?"),
    ("cddl-1.0", "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-1.0", "this common public", r"the accompanying program is provided under the terms of this common public licen[sc]e agreement"),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e(?: version 1 0)?"),
    ("apsl-2.0", "apple public", r"apple public source licen[sc]e(?: version 2 0)?"),
    ("spl-1.0", "sun public", r"sun public licen[sc]e(?: version 1 0)?"),
    ("sissl", "industry standards source", r"sun industry standards source licen[sc]e"),
    ("qpl-1.0", "q public", r"(?:the )?q public licen[sc]e(?: version 1 0)?"),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e ms pl"),
    ("ecl-2.0", "educational community", r"educational community licen[sc]e(?: version 2 0)?"),
    ("ncsa", "illinois", r"university of illinois (?:ncsa )?open source licen[sc]e"),
    ("cecill-2.1", "cecill", r"governed by the cecill(?: b| c)? licen[sc]e under french law"),
    ("cecill", "cecill", r"cecill(?: b| c)?(?: free software)? licen[sc]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: v)?(?: 1 0)?"),
    ("vim", "vim ", r"vim licen[sc]e"),
    ("curl", "curl ", r"curl licen[sc]e"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[sc]e"),
    ("icu", "unicode", r"(?:icu licen[sc]e|unicode licen[sc]e agreement) data files and software unicode"),
    ("unicode", "unicode", r"unicode (?:inc )?licen[sc]e agreement"),
    ("w3c", "w3c", r"w3c software (?:notice and|and document notice and) licen[sc]e"),
    ("tcl", "tcl", r"tcl tk licen[sc]e"),
    ("libpng", "libpng", r"(?:this copy of the )?libpng (?:notices|licen[sc]e)"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"(?:the )?freetype project licen[sc]e"),
    ("intel", "intel", r"intel (?:open source|simplified software) licen[sc]e"),
    ("nvidia", "nvidia", r"nvidia (?:source code|software|open model) licen[sc]e(?: agreement)?"),
    ("oracle", "oracle", r"oracle (?:binary code|technology network) licen[sc]e(?: agreement)?"),
    # zlib, Boost, public domain
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "held liable for any damages", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "anyone to use this software", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("boost-1.0", "obtaining a copy of the software", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("boost-1.0", "distributed under the boost", r"distributed under the boost software licen[sc]e version 1 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what", r"0 you just do what the fuck you want to"),
    ("public-domain", " the public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "author disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", "no known copyright", r"no known copyright restrictions"),
    ("public-domain", "united states government", r"works? of the united states government"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "public domain dedication", r"(?:cc0|creative commons zero) (?:1 0 )?(?:universal )?public domain dedication"),
    ("beerware", "beer", r"beer ?ware licen[sc]e(?: revision 42)?"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "used for good not evil", r"the software shall be used for good not evil"),
    ("artistic-1.0", "artistic control", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "artistic", r"this (?:package|program|software) is free software you can redistribute it and or modify it under the terms of the artistic licen[sc]e 2 0"),
    ("perl", "same terms as perl", r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("python-2.0", "psf ", r"psf licen[sc]e agreement for python"),
    ("python-2.0", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", "sil open font", r"this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("ofl-1.1", "font software", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl-1.1", "reserved font name", r"with reserved font names?"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    # Creative Commons
    ("creative-commons", "creative commons", r"this (?:work|document|book|article|image|file|content) is licensed under (?:a|the) creative commons"),
    ("creative-commons", "creative commons corporation is not a law firm", r"creative commons corporation is not a law firm and does not provide legal services"),
    ("creative-commons", "this creative commons public", r"the work as defined below is provided under the terms of this creative commons public licen[sc]e"),
    ("cc-by-4.0", "attribution 4 0 international", r"(?:creative commons )?attribution 4 0 international(?: public)?(?: licen[sc]e)?"),
    ("cc-by-sa-4.0", "sharealike 4 0 international", r"(?:creative commons )?attribution sharealike 4 0 international(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc-4.0", "noncommercial 4 0 international", r"(?:creative commons )?attribution noncommercial 4 0 international(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nd-4.0", "noderivatives 4 0 international", r"(?:creative commons )?attribution noderivatives 4 0 international(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa-4.0", "noncommercial sharealike 4 0", r"(?:creative commons )?attribution noncommercial sharealike 4 0 international(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd-4.0", "noncommercial noderivatives 4 0", r"(?:creative commons )?attribution noncommercial noderivatives 4 0 international(?: public)?(?: licen[sc]e)?"),
    ("cc-by-sa-3.0", "attribution share alike 3 0", r"(?:creative commons )?attribution share alike 3 0(?: unported)?(?: licen[sc]e)?"),
    ("cc-by-3.0", "attribution 3 0", r"(?:creative commons )?attribution 3 0(?: unported)?(?: licen[sc]e)?"),
    ("creative-commons", "you are free to", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", "as the original", r"you must distribute your contributions under the same licen[sc]e as the original"),
    ("cc-by-nd", "may not distribute the modified", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by", "give appropriate credit", r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
    ("some-rights-reserved", "some rights reserved", r"some rights reserved"),
    # Data
    ("odbl-1.0", "open database", r"made available under the open database licen[sc]e"),
    ("odbl-1.0", "database contents", r"any rights in individual contents of the database are licensed under the database contents licen[sc]e"),
    ("odc-by", "odc by", r"odc by(?: 1 0)?(?: licen[sc]e)?"),
    ("pddl", "public domain dedication and", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("cdla-permissive", "community data", r"community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", "community data", r"community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?"),
    ("ogl-uk", "open government", r"open government licen[sc]e(?: v)?(?: ?[123] 0)?"),
    ("etalab-2.0", "etalab", r"(?:etalab )?(?:licence ouverte|open licen[sc]e) (?:etalab|version 2 0 etalab)"),
    # Source available, models, proprietary
    ("sspl-1.0", "server side public", r"licensed under the server side public licen[sc]e"),
    ("bsl-1.1", "change date", r"on the change date (?:\S+ ){0,12}licensor hereby grants you rights under the terms of the change licen[sc]e"),
    ("bsl-1.1", "additional use grant", r"additional use grant"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)?(?: condition)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[sc]e(?: 1 0 0)?"),
    ("prosperity", "prosperity public", r"prosperity public licen[sc]e"),
    ("parity", "parity public", r"parity public licen[sc]e"),
    ("confluent", "confluent community", r"confluent community licen[sc]e"),
    ("fair-source", "fair source", r"fair source licen[sc]e"),
    ("functional-source", "functional source", r"functional source licen[sc]e"),
    ("llama", "llama", r"llama(?: \d)?(?: \d)? community licen[sc]e agreement"),
    ("llama", "built with", r"built with (?:meta )?llama"),
    ("gemma", "gemma", r"gemma (?:terms of use|is provided under and subject to the gemma terms)"),
    ("bigscience-rail", "bigscience", r"bigscience (?:bloom )?rail licen[sc]e(?: v)?(?: ?1 0)?"),
    ("bigcode-openrail", "bigcode", r"bigcode open ?rail m"),
    ("responsible-ai", "responsible ai", r"responsible ai licen[sc]e"),
    ("ai2-impact", "ai2 impact", r"ai2 impact licen[sc]e"),
    ("research-only", "research purposes only", r"(?:for )?(?:non ?commercial )?research purposes only"),
    ("non-commercial", "non commercial use only", r"(?:for )?(?:personal and )?non commercial use only"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", "without the prior written", r"may be reproduced (?:\S+ ){0,12}without the prior written (?:permission|consent)"),
    ("proprietary", "trade secret", r"contains? (?:trade secrets|trade secret information) (?:of|belonging to|and)"),
    ("proprietary", "end user", r"end user licen[sc]e agreement(?: eula)?"),
)

#: Where licenses are kept: label, keyword, address in words.
ADDRESSES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "apache org", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "apache org", r"(?:www )?apache org licenses license 1 1"),
    ("apache", "apache org", r"(?:www )?apache org licenses"),
    ("mit", "opensource org", r"(?:www )?opensource org licen[sc]es? mit(?: license)?(?: php)?"),
    ("apache-2.0", "opensource org", r"(?:www )?opensource org licen[sc]es? apache 2 0"),
    ("bsd-2-clause", "opensource org", r"(?:www )?opensource org licen[sc]es? bsd 2 clause"),
    ("bsd-3-clause", "opensource org", r"(?:www )?opensource org licen[sc]es? bsd 3 clause"),
    ("bsd", "opensource org", r"(?:www )?opensource org licen[sc]es? bsd license(?: php)?"),
    ("isc", "opensource org", r"(?:www )?opensource org licen[sc]es? isc(?: license)?(?: txt)?"),
    ("gpl-2.0", "opensource org", r"(?:www )?opensource org licen[sc]es? gpl 2 0"),
    ("gpl-3.0", "opensource org", r"(?:www )?opensource org licen[sc]es? gpl 3 0"),
    ("lgpl-2.1", "opensource org", r"(?:www )?opensource org licen[sc]es? lgpl 2 1"),
    ("lgpl-3.0", "opensource org", r"(?:www )?opensource org licen[sc]es? lgpl 3 0"),
    ("agpl-3.0", "opensource org", r"(?:www )?opensource org licen[sc]es? agpl 3 0"),
    ("mpl-2.0", "opensource org", r"(?:www )?opensource org licen[sc]es? mpl 2 0"),
    ("epl-2.0", "opensource org", r"(?:www )?opensource org licen[sc]es? epl 2 0"),
    ("zlib", "opensource org", r"(?:www )?opensource org licen[sc]es? zlib"),
    ("unlicense", "unlicense org", r"(?:www )?unlicense org"),
    ("gpl-3.0", "gnu org", r"(?:www )?gnu org (?:licenses|copyleft) gpl(?: 3 0)?(?: html| txt)?"),
    ("gpl-2.0", "gnu org", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("lgpl", "gnu org", r"(?:www )?gnu org (?:licenses|copyleft) lgpl(?: html| txt)?"),
    ("lgpl-2.1", "gnu org", r"(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?"),
    ("agpl-3.0", "gnu org", r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", "gnu org", r"(?:www )?gnu org (?:licenses|copyleft) fdl(?: html| txt)?"),
    ("gnu", "gnu org", r"(?:www )?gnu org licenses"),
    ("mpl-2.0", "mozilla org", r"(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org", r"(?:www )?mozilla org mpl mpl 1 1(?: html)?"),
    ("mpl", "mozilla org", r"(?:www )?mozilla org mpl"),
    ("epl-2.0", "eclipse org", r"(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("epl-1.0", "eclipse org", r"(?:www )?eclipse org legal epl v10(?: html)?"),
    ("boost-1.0", "boost org", r"(?:www )?boost org license 1 0(?: txt)?"),
    ("wtfpl", "wtfpl net", r"(?:www )?wtfpl net"),
    ("ofl-1.1", "sil org", r"scripts sil org ofl"),
    ("cc-by-4.0", "creativecommons org", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons org", r"creativecommons org licenses by 3 0"),
    ("cc-by-2.0", "creativecommons org", r"creativecommons org licenses by 2 [05]"),
    ("cc-by-sa-4.0", "creativecommons org", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons org", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org", r"creativecommons org licenses by nc nd 4 0"),
    ("creative-commons", "creativecommons org", r"creativecommons org licenses"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("odbl-1.0", "opendatacommons org", r"(?:www )?opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org", r"(?:www )?opendatacommons org licenses by"),
    ("pddl", "opendatacommons org", r"(?:www )?opendatacommons org licenses pddl"),
)

#: Identifiers after "SPDX-License-Identifier:", in words, and their labels.
IDENTIFIERS: tuple[tuple[str, str], ...] = (
    ("0bsd", "0bsd"), ("afl-3.0", "afl 3 0"), ("agpl-3.0-only", "agpl 3 0(?: only)?"), ("agpl-3.0-or-later", "agpl 3 0 or later"),
    ("apache-1.1", "apache 1 1"), ("apache-2.0", "apache 2 0"), ("apsl-2.0", "apsl 2 0"), ("artistic-1.0", "artistic 1 0"), ("artistic-2.0", "artistic 2 0"),
    ("blueoak-1.0.0", "blueoak 1 0 0"), ("bsd-1-clause", "bsd 1 clause"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-2-clause-patent", "bsd 2 clause patent"),
    ("bsd-3-clause", "bsd 3 clause"), ("bsd-3-clause-clear", "bsd 3 clause clear"), ("bsd-4-clause", "bsd 4 clause"), ("boost-1.0", "bsl 1 0"), ("bsl-1.1", "busl 1 1"),
    ("cc0-1.0", "cc0 1 0"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cddl-1.0", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("cecill-2.1", "cecill 2 1"), ("cpl-1.0", "cpl 1 0"), ("ecl-2.0", "ecl 2 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"),
    ("eupl-1.1", "eupl 1 1"), ("eupl-1.2", "eupl 1 2"), ("gfdl-1.3", "gfdl 1 3(?: only| or later)?"), ("gpl-1.0", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0-only", "gpl 2 0(?: only)?"), ("gpl-2.0-or-later", "gpl 2 0 or later"), ("gpl-3.0-only", "gpl 3 0(?: only)?"), ("gpl-3.0-or-later", "gpl 3 0 or later"),
    ("hpnd", "hpnd"), ("isc", "isc"), ("ijg", "ijg"), ("json", "json"), ("lgpl-2.0", "lgpl 2 0(?: only| or later)?"), ("lgpl-2.1-only", "lgpl 2 1(?: only)?"),
    ("lgpl-2.1-or-later", "lgpl 2 1 or later"), ("lgpl-3.0-only", "lgpl 3 0(?: only)?"), ("lgpl-3.0-or-later", "lgpl 3 0 or later"), ("libpng", "libpng(?: 2 0)?"),
    ("mit", "mit"), ("mit-0", "mit 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("mulanpsl-2.0", "mulanpsl 2 0"), ("ncsa", "ncsa"),
    ("odbl-1.0", "odbl 1 0"), ("odc-by", "odc by 1 0"), ("ofl-1.1", "ofl 1 1"), ("openssl", "openssl"), ("osl-3.0", "osl 3 0"), ("pddl", "pddl 1 0"), ("php-3.01", "php 3 01"),
    ("postgresql", "postgresql"), ("python-2.0", "(?:python|psf) 2 0"), ("ruby", "ruby"), ("sspl-1.0", "sspl 1 0"), ("unicode", "unicode(?: dfs 2016| 3 0)?"), ("unlicense", "unlicense"),
    ("upl-1.0", "upl 1 0"), ("vim", "vim"), ("w3c", "w3c"), ("wtfpl", "wtfpl"), ("x11", "x11"), ("zlib", "zlib"), ("zpl-2.1", "zpl 2 1"),
)

#: Names of licenses: label, keyword, pattern. A longer match of equal priority hides a shorter one.
NAMES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?"),
    ("apache-2.0", "apache 2", r"apache 2(?: 0)?(?: licen[sc]e)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("mit", "mit", r"mit licen[sc]e"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit-0", "mit no", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|bsd two clause) licen[sc]e"),
    ("bsd-2-clause", "2 clause", r"2 clause licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|bsd three clause) licen[sc]e"),
    ("bsd-3-clause", "3 clause", r"3 clause licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|bsd four clause) licen[sc]e"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v)?3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agpl(?: ?v?3(?: 0)?)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl", r"lgpl ?v?3(?: 0)?"),
    ("lgpl", "lgpl", r"lgpl"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl-2.0", "gpl", r"gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gpl ?v?3(?: 0)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: (?:version |v)?1 [123])?"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v)?1 1"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("cddl", "common development", r"common development and distribution licen[sc]e(?: (?:version |v)?1 [01])?"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: (?:version |v)?1 0)?"),
    ("eupl", "european union", r"european union public licen[sc]e(?: (?:version |v)?1 [12])?"),
    ("osl-3.0", "open software", r"open software licen[sc]e(?: (?:version |v)?3 0)?"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?: (?:version |v)?3 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version |v)?2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: (?:version |v)?1 0)?"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v)?1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[sc]e)?"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("python-2.0", "python", r"python(?: software foundation)? licen[sc]e(?: (?:version |v)?2)?"),
    ("python-2.0", "psf", r"psf licen[sc]e(?: (?:version |v)?2)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: (?:version |v)?3 01)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e(?: (?:version |v)?2 1)?"),
    ("mulanpsl-2.0", "mulan", r"mulan (?:permissive|public) (?:software )?licen[sc]e(?: (?:version |v)?2)?"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: (?:version |v)?1 1)?"),
    ("odbl-1.0", "database licen", r"open (?:data commons open )?database licen[sc]e(?: (?:version |v)?1 0)?"),
    ("odc-by", "open data", r"open data commons attribution licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("bsl-1.1", "business source", r"business source licen[sc]e(?: (?:version |v)?1 1)?"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?: (?:version |v)?1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?: [ms])?(?: licen[sc]e)?"),
    ("llama", "llama", r"llama(?: [23])? community licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "by nc sa", r"(?:cc|creative commons) by nc sa(?: [1234] 0)?"),
    ("cc-by-nc-nd", "by nc nd", r"(?:cc|creative commons) by nc nd(?: [1234] 0)?"),
    ("cc-by-nc", "by nc", r"(?:cc|creative commons) by nc(?: [1234] 0)?"),
    ("cc-by-sa", "by sa", r"(?:cc|creative commons) by sa(?: [1234] 0)?"),
    ("cc-by-nd", "by nd", r"(?:cc|creative commons) by nd(?: [1234] 0)?"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by", "cc by", r"cc by"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1234] 0)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] 0)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1234] 0)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] 0)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1234] 0)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1234] 0)?"),
    ("creative-commons", "creative commons", r"creative commons licen[sc]e"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "rights reserved", r"all rights reserved"),
)

#: How a grant leads up to a name.
GRANT = r"(?:(?:dual )?licensed|(?:released|distributed|published|available|provided|covered|redistributed)(?: and modified)?) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"


def rules() -> tuple[Rule, ...]:
    """All rules: texts, identifiers, grants, addresses, names; a rule's number is its place."""
    listed = [
        *(("text", label, 90, keyword, pattern) for label, keyword, pattern in TEXTS),
        *(("identifier", label, 95, "spdx", f"spdx licen[sc]e identifier {words}") for label, words in IDENTIFIERS),
        *(("grant", label, 80, keyword, f"{GRANT}(?:{pattern})") for label, keyword, pattern in NAMES if "licen" in pattern),
        *(("address", label, 70, keyword, pattern) for label, keyword, pattern in ADDRESSES),
        *(("name", label, 50, keyword, pattern) for label, keyword, pattern in NAMES),
    ]
    return tuple(Rule(f"{kind}/{label}/{n}", label, priority, keyword, f"(?<= )(?:{pattern})(?= )") for n, (kind, label, priority, keyword, pattern) in enumerate(listed))
