"""License scans by ordered signature rules (operator 8).

A text is seen as its words, joined by single spaces. Base phrases are places where their words
stand consecutively. The rules are regexes over the joined words, each with a label, a rank (0 is
the strongest) and a keyword, a word that stands in whatever its regex matches; a rule runs only on
texts that have its keyword among their words. Detections are word intervals. One that lies
within another of the same or a stronger rank is suppressed; of equal intervals the one of the
stronger rank, then of the first label, stays.

The main path is DataFrame functions: texts are scanned once, the rules are joined by keyword (a
table of fixed size), matches become rows, and suppression is a running maximum over the detections
of a document.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.llm.common import ascii_lower, words_of
from weftlog.plans.scratch import materialize, measured, passing_tables

#: Base phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families: label stem, names as words, initials that count with a version only, versions ("" where there is none) (fixed values).
FAMILIES = [
    ("apache", ["apache software license", "apache license", "apache"], ["asl"], ["1.0", "1.1", "2.0"]),
    ("mit", ["mit license", "mit x11 license", "expat license"], [], [""]),
    ("gpl", ["gnu general public license", "general public license", "gnu gpl", "gpl"], [], ["1.0", "2.0", "3.0"]),
    ("lgpl", ["gnu lesser general public license", "lesser general public license", "gnu library general public license", "gnu lesser gpl", "lesser gpl", "library gpl", "gnu lgpl", "lgpl"], [], ["2.0", "2.1", "3.0"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu affero gpl", "affero gpl", "gnu agpl", "agpl"], [], ["1.0", "3.0"]),
    ("gfdl", ["gnu free documentation license", "free documentation license"], ["gfdl", "gnu fdl"], ["1.1", "1.2", "1.3"]),
    ("mpl", ["mozilla public license", "mozilla"], ["mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public license"], ["epl"], ["1.0", "2.0"]),
    ("edl", ["eclipse distribution license"], ["edl"], ["1.0"]),
    ("cddl", ["common development and distribution license"], ["cddl"], ["1.0", "1.1"]),
    ("cpl", ["common public license"], ["cpl"], ["0.5", "1.0"]),
    ("eupl", ["european union public license", "european union public licence"], ["eupl"], ["1.0", "1.1", "1.2"]),
    ("osl", ["open software license"], ["osl"], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free license"], ["afl"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", ["artistic license", "perl artistic license"], ["artistic"], ["1.0", "2.0"]),
    ("bsd", ["bsd license", "bsd licence", "berkeley software distribution license"], [], [""]),
    ("isc", ["isc license", "internet systems consortium license"], [], [""]),
    ("zlib", ["zlib license", "zlib libpng license"], [], [""]),
    ("boost", ["boost software license"], ["bsl"], ["1.0"]),
    ("python", ["python software foundation license", "psf license"], ["psf"], ["2.0"]),
    ("ruby", ["ruby license"], [], [""]),
    ("php", ["php license"], ["php"], ["3.0", "3.01"]),
    ("postgresql", ["postgresql license"], [], [""]),
    ("openssl", ["openssl license"], [], [""]),
    ("unlicense", ["the unlicense", "unlicense license"], [], [""]),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], [], [""]),
    ("ofl", ["sil open font license", "open font license"], ["ofl"], ["1.0", "1.1"]),
    ("odbl", ["open database license", "open data commons open database license"], ["odbl"], ["1.0"]),
    ("odc-by", ["open data commons attribution license"], ["odc by"], ["1.0"]),
    ("pddl", ["public domain dedication and license"], ["pddl"], ["1.0"]),
    ("ms-pl", ["microsoft public license"], [], [""]),
    ("ms-rl", ["microsoft reciprocal license"], [], [""]),
    ("upl", ["universal permissive license"], ["upl"], ["1.0"]),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], [], [""]),
    ("nasa", ["nasa open source agreement"], ["nosa"], ["1.3"]),
    ("qpl", ["q public license"], ["qpl"], ["1.0"]),
    ("sleepycat", ["sleepycat license"], [], [""]),
    ("vim", ["vim license"], [], [""]),
    ("w3c", ["w3c license", "w3c software notice and license"], [], [""]),
    ("zope", ["zope public license"], ["zpl"], ["1.1", "2.0", "2.1"]),
    ("sspl", ["server side public license"], ["sspl"], ["1.0"]),
    ("busl", ["business source license"], ["busl"], ["1.0", "1.1"]),
    ("elastic", ["elastic license"], ["elastic"], ["1.0", "2.0"]),
    ("cc0", ["creative commons zero", "cc0", "creative commons cc0"], [], ["", "1.0"]),
    ("openrail", ["open rail license", "openrail m license", "bigscience rail license"], [], ["", "1.0"]),
    ("beerware", ["beerware license", "beer ware license"], [], [""]),
]
#: Creative Commons terms: the label's ending, the names' ending in words and as initials (fixed values).
CC_TERMS = [("", "attribution", "by"), ("-sa", "attribution share ?alike", "by sa"), ("-nc", "attribution non ?commercial", "by nc"), ("-nd", "attribution no ?deriv(?:ative)?s?", "by nd"), ("-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"), ("-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?", "by nc nd")]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0", ""]
#: Names that stand in one word with v and the version, as in GPLv3, beside the initials above (fixed values).
GLUED = ["gpl", "gnu gpl", "lgpl", "gnu lgpl", "agpl", "gnu agpl", "apache"]
#: Signatures from the texts of licenses and from usual notices: label, rank, regex over joined words (fixed values).
SIGNATURES = [
    ("mit", 1, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", 1, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 2, "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-0", 1, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", 1, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 1, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 2, "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 1, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", 2, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 2, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 2, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", 1, "neither the names? of (?:the copyright holders?|the author|the university|the organization|the company|[^ ]+ [^ ]+|[^ ]+) nor the names of (?:its|any|their) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 1, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 3, "this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-clause-clear", 1, "no express or implied licenses to any partys? patent rights are granted by this license"),
    ("apache-2.0", 1, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 1, "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2.0", 1, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 1, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 2, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", 2, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-1.1", 1, "this product includes software developed by the apache software foundation"),
    ("apache-1.0", 1, "this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl", 1, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", 1, "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", 1, "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", 1, "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", 1, "under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("gpl", 2, "see the gnu general public license for more details"),
    ("gpl", 2, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 2, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 1, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", 2, "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("gpl-2.0", 2, "this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license"),
    ("gpl-classpath-exception", 1, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-gcc-exception", 1, "gcc runtime library exception"),
    ("gpl-autoconf-exception", 1, "autoconf configure script exception"),
    ("gpl-font-exception", 1, "if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("lgpl", 1, "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl-2.1", 1, "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", 1, "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", 2, "see the gnu (?:lesser|library) general public license for more details"),
    ("lgpl-3.0", 1, "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", 1, "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl", 2, "see the gnu affero general public license for more details"),
    ("agpl-3.0", 1, "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("gfdl", 1, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 2, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 1, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 1, "if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0"),
    ("mpl-2.0", 1, "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", 1, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", 1, "the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl", 1, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 2, "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl", 2, "the accompanying program is provided under the terms of this common public license"),
    ("cddl", 1, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", 1, "licensed under the eupl version 1 [0-2]"),
    ("artistic", 2, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 1, "same terms as perl itself"),
    ("artistic-2.0", 2, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied"),
    ("boost-1.0", 1, "distributed under the boost software license version 1 0 see accompanying file"),
    ("boost-1.0", 2, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 1, "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 1, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 2, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", 1, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 1, "you just do what the fuck you want to"),
    ("beerware", 1, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("openssl", 1, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("python-2.0", 1, "this license agreement is between the python software foundation psf and the individual or organization"),
    ("php-3.01", 1, "this product includes php software freely available from"),
    ("postgresql", 1, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", 1, "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 2, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("odbl-1.0", 1, "is made available under the open database license"),
    ("cc0", 1, "to the extent possible under law [^ ]+ has waived all copyright and related or neighboring rights"),
    ("cc0", 2, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", 1, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", 1, "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", 1, "you may not use the material for commercial purposes"),
    ("cc-by-nd", 1, "if you remix transform or build upon the material you may not distribute the modified material"),
    ("creative-commons", 2, "this work is licensed under a creative commons [^ ]+"),
    ("creative-commons", 3, "some rights reserved"),
    ("sspl-1.0", 1, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", 1, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", 1, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 1, "the license does not grant to you the right to sell the software"),
    ("json", 1, "the software shall be used for good not evil"),
    ("public-domain", 4, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 4, "in the public domain"),
    ("copyright", 4, "copyright(?: c)? [12][0-9]{3}(?: [12][0-9]{3})?"),
    ("copyright", 4, "all content is copyright(?:ed)?"),
    ("proprietary", 4, "(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 4, "unauthorized (?:copying|reproduction|distribution)(?: of this (?:file|document|work))?"),
    ("proprietary", 4, "may not be reproduced(?: or distributed)? in any form"),
    ("permission", 4, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("permission", 4, "permission to use copy modify and or distribute this (?:software|work)"),
    ("permission", 4, "redistribution and use in source and binary forms(?: with or without modification)?"),
    ("permission", 4, "(?:used|reprinted|reproduced) (?:with|by) permission"),
    ("warranty-disclaimer", 4, "provided as is without warranty of any kind"),
    ("warranty-disclaimer", 4, "without warranties or conditions of any kind"),
    ("warranty-disclaimer", 4, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("unknown-license", 4, "(?:licensed|released|distributed) under (?:the|a) [^ ]+ licen[sc]e"),
    ("unknown-license", 4, "licen[sc]ed under"),
    ("unknown-license", 4, "no licen[sc]e (?:is )?granted"),
]
#: A choice has a weaker rank than the other name in it, so that it covers none.
#: Notices with a short name, as people write them, and addresses of licenses, as words: label, rank, regex (fixed values).
NOTICES = [
    ("mit", 1, "mit licensed"),
    ("mit", 1, "license mit(?! licen)"),
    ("mit", 1, "licence mit(?! licen)"),
    ("mit", 1, "licenses mit(?! licen)"),
    ("mit", 1, "licensed under (?:the )?mit"),
    ("mit", 1, "released under (?:the )?mit"),
    ("mit", 1, "distributed under (?:the )?mit"),
    ("mit", 2, "mit style license"),
    ("mit", 3, "apache 2 0 or mit"),
    ("mit", 3, "apache 2 0 and mit"),
    ("mit", 3, "gpl or mit"),
    ("mit", 3, "bsd or mit"),
    ("mit", 3, "mit or apache"),
    ("mit", 3, "mit and apache"),
    ("mit", 3, "mit or gpl"),
    ("mit", 3, "mit or bsd"),
    ("mit", 1, "dual licensed under (?:the )?mit"),
    ("apache", 1, "apache licensed"),
    ("apache", 1, "license apache(?! licen)"),
    ("apache", 1, "licence apache(?! licen)"),
    ("apache", 1, "licensed under (?:the )?apache"),
    ("apache", 1, "dual licensed under (?:the )?apache"),
    ("apache", 2, "apache style license"),
    ("mpl", 1, "mozilla licensed"),
    ("mpl", 1, "license mozilla(?! licen)"),
    ("mpl", 1, "licensed under (?:the )?mozilla"),
    ("mpl", 1, "license mpl(?! licen)"),
    ("mpl", 1, "mpl licensed"),
    ("bsd", 1, "bsd licensed"),
    ("bsd", 1, "license bsd(?! licen)"),
    ("bsd", 1, "licence bsd(?! licen)"),
    ("bsd", 1, "licensed under (?:the )?bsd"),
    ("bsd", 1, "released under (?:the )?bsd"),
    ("bsd", 1, "dual licensed under (?:the )?bsd"),
    ("bsd", 2, "bsd style license"),
    ("bsd", 2, "bsd like license"),
    ("bsd-2-clause", 1, "simplified bsd license"),
    ("bsd-2-clause", 1, "freebsd license"),
    ("bsd-3-clause", 1, "new bsd license"),
    ("bsd-3-clause", 1, "modified bsd license"),
    ("bsd-3-clause", 1, "revised bsd license"),
    ("bsd-4-clause", 1, "original bsd license"),
    ("bsd-4-clause", 1, "old bsd license"),
    ("isc", 1, "isc licensed"),
    ("isc", 1, "license isc(?! licen)"),
    ("isc", 1, "licence isc(?! licen)"),
    ("isc", 1, "licensed under (?:the )?isc"),
    ("isc", 1, "released under (?:the )?isc"),
    ("zlib", 1, "license zlib(?! licen)"),
    ("zlib", 1, "licensed under (?:the )?zlib"),
    ("gpl", 1, "gpl licensed"),
    ("gpl", 1, "license gpl(?! licen)"),
    ("gpl", 1, "dual licensed under (?:the )?gpl"),
    ("lgpl", 1, "license lgpl(?! licen)"),
    ("agpl", 1, "license agpl(?! licen)"),
    ("epl", 1, "license epl(?! licen)"),
    ("unlicense", 1, "license unlicense(?! licen)"),
    ("unlicense", 1, "licensed under (?:the )?unlicense"),
    ("public-domain", 4, "license public domain"),
    ("dual-license", 4, "dual licensed"),
    ("dual-license", 4, "dual license"),
    ("dual-license", 4, "licensed under either of"),
    ("dual-license", 4, "at your option under the terms of either"),
    ("mit", 1, "opensource org licenses? mit(?: license php)?"),
    ("apache-2.0", 1, "opensource org licenses? apache 2 0"),
    ("apache-2.0", 1, "apache org licenses license 2 0"),
    ("apache-1.1", 1, "apache org licenses license 1 1"),
    ("apache", 2, "apache org licenses"),
    ("bsd-2-clause", 1, "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", 1, "opensource org licenses? bsd 3 clause"),
    ("bsd", 2, "opensource org licenses? bsd license(?: php)?"),
    ("gpl-2.0", 1, "opensource org licenses? gpl 2 0"),
    ("gpl-3.0", 1, "opensource org licenses? gpl 3 0"),
    ("lgpl-2.1", 1, "opensource org licenses? lgpl 2 1"),
    ("lgpl-3.0", 1, "opensource org licenses? lgpl 3 0"),
    ("agpl-3.0", 1, "opensource org licenses? agpl 3 0"),
    ("mpl-2.0", 1, "opensource org licenses? mpl 2 0"),
    ("epl-1.0", 1, "opensource org licenses? epl 1 0"),
    ("epl-2.0", 1, "opensource org licenses? epl 2 0"),
    ("isc", 1, "opensource org licenses? isc(?: license(?: txt)?)?"),
    ("zlib", 1, "opensource org licenses? zlib"),
    ("artistic-2.0", 1, "opensource org licenses? artistic(?: license)? 2 0"),
    ("gpl-2.0", 1, "gnu org licenses old licenses gpl 2 0"),
    ("gpl-2.0", 1, "gnu org licenses gpl 2 0"),
    ("gpl-3.0", 1, "gnu org licenses gpl 3 0"),
    ("gpl", 2, "gnu org licenses gpl"),
    ("gpl", 2, "gnu org copyleft gpl"),
    ("lgpl-2.1", 1, "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", 1, "gnu org licenses lgpl 3 0"),
    ("lgpl", 2, "gnu org licenses lgpl"),
    ("lgpl", 2, "gnu org copyleft lesser"),
    ("agpl-3.0", 1, "gnu org licenses agpl 3 0"),
    ("agpl", 2, "gnu org licenses agpl"),
    ("gfdl-1.3", 1, "gnu org licenses fdl 1 3"),
    ("gfdl", 2, "gnu org licenses fdl"),
    ("mpl-1.1", 1, "mozilla org mpl mpl 1 1"),
    ("mpl-2.0", 1, "mozilla org mpl 2 0"),
    ("mpl", 2, "mozilla org mpl"),
    ("epl-1.0", 1, "eclipse org legal epl v10"),
    ("epl-2.0", 1, "eclipse org legal epl 2 0"),
    ("boost-1.0", 1, "boost org license 1 0"),
    ("unlicense", 1, "unlicense org"),
    ("wtfpl", 1, "wtfpl net"),
    ("ofl", 1, "scripts sil org ofl"),
    ("odbl-1.0", 1, "opendatacommons org licenses odbl"),
    ("odc-by-1.0", 1, "opendatacommons org licenses by"),
    ("pddl-1.0", 1, "opendatacommons org licenses pddl"),
    ("cc0-1.0", 1, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 2, "creativecommons org publicdomain mark"),
    ("creative-commons", 3, "creativecommons org licenses"),
]
#: Names that are also names of other things: without a version they count only in the notices above (fixed values).
BARE = ["apache", "mozilla"]
#: Words that say little: a rule has one as its keyword only if it requires no other (the first ones least). Initials of
#: two letters stand in texts of all kinds, and one name is a preposition in another language.
COMMON = ["nd", "sa", "nc", "by", "mit", "the", "a", "of", "to", "and", "in", "is", "for", "any", "all", "this", "use", "you", "want", "do", "what", "version", "as", "without", "free", "open", "side", "system", "source", "software", "general", "common", "public", "license", "licence", "permitted", "provided", "under", "content", "hereby"]
#: Confidence of a detection by rank, and of a base phrase alone.
CONFIDENCE, BASE_CONFIDENCE = (1.0, 0.95, 0.8, 0.6, 0.4), 0.5
#: Characters of text in a task that runs the rules.
TASK_CHARS = 4_000_000


def keyword_of(regex: str) -> str:
    """A word that every match of a regex over joined words has, the one that says the most.

    Known are literals, groups of alternatives, character classes and the quantifiers ? and {n}.
    """

    def texts(tree) -> list[str]:
        """Every form, with a mark for a character that may vary."""
        parts = []
        for op, value in tree:
            op = str(op)
            if op == "LITERAL":
                parts.append([chr(value)])
            elif op == "SUBPATTERN":
                parts.append(texts(value[3]))
            elif op == "BRANCH":
                parts.append([t for branch in value[1] for t in texts(branch)])
            elif op == "MAX_REPEAT":
                low, high, inner = value
                parts.append(sorted({t * n for t in texts(inner) for n in (low, min(int(high), low + 1))}))
            elif op in ("IN", "NOT_LITERAL", "ANY"):
                parts.append(["?"])
            elif op not in ("ASSERT", "ASSERT_NOT"):  # these match no character
                raise ValueError(f"{op} in {regex}")
        return ["".join(x) for x in product(*parts)]

    words = set.intersection(*(set(t.split(" ")) for t in texts(re._parser.parse(regex))))
    words = {w for w in words if w and "?" not in w}
    return max(words, key=lambda w: (not w.isdigit(), COMMON.index(w) if w in COMMON else len(COMMON), len(w), w))


def _version(version: str) -> str:
    """A version as words; the last part may be missing where it is 0."""
    head, _, last = version.rpartition(".")
    return head.replace(".", " ") + (f"(?: {last})?" if last == "0" else f" {last}")


@lru_cache(1)
def rules() -> list[tuple[str, int, str, str, float]]:
    """(label, rank, regex, keyword, confidence) of every rule, in order: the signatures above, and every form of every name and version.

    Ranks: 0 an SPDX identifier, 1 a notice that grants a named license or a sentence that only it has, 2 a
    name with a version or a sentence of its text, 3 a name alone, 4 a notice without a name.
    """
    named = [(stem, name, version) for stem, names, initials, versions in FAMILIES for version in versions for name in [*names, *(i for i in initials if version)]]
    initials = {i for *_, initials, _ in FAMILIES for i in initials}
    for end, name, short in CC_TERMS:
        for version in CC_VERSIONS:
            named += [(f"cc-by{end}", f"creative commons {name}", version), (f"cc-by{end}", f"cc {short}", version)]
    forms: list[tuple[str, str, str]] = []  # label, version, regex of the name and version
    out: list[tuple[str, int, str, str]] = []
    for stem, name, version in named:
        label = f"{stem}-{version}" if version else stem
        number = f"{_version(version)}(?: only| or later| or any later version)?" if version else ""
        forms.append((label, version, f"{name}(?: licen[sc]e)?(?: version| v)? v?{number}" if version else name))
        if version and (name in GLUED or name in initials):
            forms.append((label, version, f"{name}v{number}(?: licen[sc]e)?"))
        if version and name not in initials and name not in BARE:
            out.append((stem, 3, name, keyword_of(name)))
        out.append((label, 0, f"spdx license identifier {stem.replace('-', ' ')}" + (f" {number}" if version else ""), "spdx"))
    for n in "01234":
        forms.append((f"bsd-{n}-clause", n, f"(?:bsd {n} clause|{n} clause bsd)(?: licen[sc]e)?"))
        out.append((f"bsd-{n}-clause", 0, f"spdx license identifier bsd {n} clause", "spdx"))
    for label, version, one in dict.fromkeys(forms):
        keyword = keyword_of(one)
        out.append((label, 1, f"(?:licensed|released|distributed|available|published)(?: and made available)? under (?:the )?(?:terms of (?:the )?)?{one}", keyword))
        out.append((label, 2 if version else 3, one, keyword))
    for end, _, short in CC_TERMS:
        out += [(f"cc-by{end}" + (f"-{v}" if v else ""), 1, f"creativecommons org licenses {short}" + (f" {_version(v)}" if v else ""), "creativecommons") for v in CC_VERSIONS]
    out += [(label, rank, regex, keyword_of(regex)) for label, rank, regex in [*SIGNATURES, *NOTICES]]
    return [(label, rank, f" {regex}(?= )", keyword, CONFIDENCE[rank]) for label, rank, regex, keyword in dict.fromkeys(out)]


def _places(words: Column, lowered: Column, phrase: str) -> Column:
    """Starts of a phrase among the words, looked for only where the text has each of its words."""
    parts = phrase.split(" ")
    has = F.lit(True)
    for w in parts:
        has = has & F.contains(lowered, F.lit(w))

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(parts):
            ok = ok & (F.get(words, i + k) == w)
        return F.coalesce(ok, F.lit(False))

    none = F.array().cast("array<int>")
    return F.when(has & (F.size(words) >= len(parts)), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(none)


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _keywords() -> Column:
    return F.array(*[F.lit(k) for k in sorted({r[3] for r in rules()})])


def detections(texts: DataFrame, key: list[str], gated: bool = True) -> DataFrame:
    """key, label, rank, confidence, start and end (words, end exclusive) of the kept detections.

    texts: the key columns and ``joined``, the words with a space before and after each. Without
    the gate every rule runs on every text, with the same result.
    """
    spark: SparkSession = texts.sparkSession
    table = spark.createDataFrame(rules(), "label string, rank int, regex string, keyword string, confidence double")
    if gated:
        rows = texts.select(*key, "joined", F.explode(F.array_intersect(F.split("joined", " "), _keywords())).alias("keyword")).join(F.broadcast(table), "keyword")
    else:
        rows = texts.crossJoin(F.broadcast(table))
    pieces = F.expr("split(joined, regex, -1)")
    matches = F.expr("regexp_extract_all(joined, regex, 0)")
    hits = rows.where(F.expr("rlike(joined, regex)")).select(*key, "label", "rank", "confidence", "regex", F.posexplode(F.arrays_zip(pieces.alias("piece"), matches.alias("match"))).alias("k", "z"))
    hits = hits.select(*key, "label", "rank", "confidence", "regex", "k", _spaces(F.coalesce("z.piece", F.lit(""))).alias("gap"), _spaces(F.coalesce("z.match", F.lit(""))).alias("size"))
    so_far = Window.partitionBy(*key, "regex", "label").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    spans = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).where("size > 0")
    spans = spans.select(*key, "label", "rank", "confidence", (F.col("end") - F.col("size")).alias("start"), "end").distinct()
    before = Window.partitionBy(*key).orderBy("start", F.desc("end"), "rank", "label").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for rank in range(len(CONFIDENCE)):  # within an earlier or longer one of this or a stronger rank
        reach = F.max(F.when(F.col("rank") <= rank, F.col("end"))).over(before)
        covered = covered | ((F.col("rank") == rank) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    return spans.withColumn("covered", covered).where("not covered").drop("covered")


def scan(docs: DataFrame) -> DataFrame:
    """One row for every row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    spans are the kept detections (label, start, end). A null or empty text has no words, no labels
    (empty strings), null first and last words and score 0. score is the confidence of the
    strongest detection. Repeated rows and rows of one doc_id each get a row by their own text;
    other columns are ignored; an empty table gives an empty result.
    """
    with passing_tables(docs.sparkSession):
        return materialize(_scan(docs), "license-rows", keep=True)


def _scan(docs: DataFrame) -> DataFrame:
    lowered = F.coalesce(ascii_lower(F.col("text")), F.lit(""))
    one = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), lowered.alias("lowered"), words_of(F.col("text")).alias("words"))
    one = one.select("doc_id", "h1", "h2", F.size("words").alias("n_words"), *[_places(F.col("words"), F.col("lowered"), p).alias(f"p{k}") for k, p in enumerate(PHRASES)], F.when(F.arrays_overlap("words", _keywords()), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("joined"))
    labels = F.array_sort(F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull()))
    places = F.concat(*[f"p{k}" for k in range(len(PHRASES))])
    one = one.select("doc_id", "h1", "h2", F.col("n_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), labels.alias("base"), "joined")
    one, seen = measured(one, "license-scan", F.coalesce(F.sum(F.length("joined")), F.lit(0)).alias("chars"))
    key = ["doc_id", "h1", "h2"]
    # rules cost in proportion to the text they look at: tasks of about as much, each row of a text in the same one
    texts = one.where("joined is not null").select(*key, "joined").repartition(1 + seen["chars"] // TASK_CHARS, *key).distinct()
    found = detections(texts, key).groupBy(*key).agg(F.collect_set("label").alias("more"), F.max("confidence").alias("best"), F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    found = found.withColumnsRenamed({k: f"_{k}" for k in key})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    none = F.array().cast("array<string>")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0))
    joined = one.drop("joined").join(found, same, "left")
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.alias("score"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
