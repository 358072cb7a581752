"""License wording as template markup.

`<<opt>> ... <<end>>` may be left out, `<<one>> a <<or>> b <<end>>` is exactly one of its choices, and `<<any N>>` stands
for up to N words (names, years). All other words must be there, in order. Words are lower-case runs of letters and
digits, so punctuation doesn't count."""

from __future__ import annotations

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<one>>noninfringement<<or>>non infringement<<end>>"
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted <<opt>>disjunctively or conjunctively<<end>> provided that the following conditions are met "
    "<<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_END = (
    "this software is provided by <<any 8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any 8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU = "<<opt>>gnu<<end>> {} public license as published by the free software foundation <<one>>either version <<any 2>> of the license or <<opt>>at your option<<end>> any later version<<or>>version <<any 2>> of the license<<or>>version <<any 2>><<end>>"
_UNDER = "<<one>>licensed<<or>>released<<or>>distributed<<or>>published<<or>>available<<end>> under <<opt>>the terms of<<end>>"

# The wording of licenses and of their notices, by label.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
        + _AS_IS
        + " in no event shall <<any 6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit", f"{_UNDER} the mit license"),
    ("bsd-2-clause", _BSD_START + _BSD_END),
    ("bsd-3-clause", _BSD_START + "<<opt>>3<<end>> neither the name of <<any 8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END),
    ("bsd", f"{_UNDER} <<one>>the<<or>>a<<end>> <<opt>><<one>>2 clause<<or>>3 clause<<or>>new<<or>>simplified<<or>>modified<<end>><<end>> bsd <<opt>><<one>>2 clause<<or>>3 clause<<end>><<end>> license"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<any 6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<any 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "<<opt>><<one>>http<<or>>https<<end>><<end>> www apache org licenses license 2 0 <<opt>><<one>>txt<<or>>html<<end>><<end>> "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("apache-2.0", f"{_UNDER} the apache license <<opt>>version<<end>> 2 0"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the " + _GNU.format("general")),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the " + _GNU.format("lesser general")),
    ("agpl", "is free software you can redistribute it and or modify it under the terms of the " + _GNU.format("affero general")),
    ("gpl", f"{_UNDER} the gnu general public license <<opt>><<opt>>version<<end>> <<one>>1<<or>>2<<or>>3<<or>>v2<<or>>v3<<end>> <<opt>>0<<end>> <<opt>>or later<<end>><<end>>"),
    ("lgpl", f"{_UNDER} the gnu lesser general public license <<opt>><<opt>>version<<end>> <<one>>2<<or>>3<<or>>v2<<or>>v3<<or>>2 1<<end>> <<opt>>or later<<end>><<end>>"),
    ("agpl", f"{_UNDER} the gnu affero general public license <<opt>><<opt>>version<<end>> <<one>>3<<or>>v3<<end>> <<opt>>0<<end>> <<opt>>or later<<end>><<end>>"),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<one>>http<<or>>https<<end>> <<one>>mozilla org mpl 2 0<<or>>www mozilla org mpl 2 0<<end>>",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the <<one>>author<<or>>authors<<end>> be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    ("cc-by", f"{_UNDER} <<opt>><<one>>a<<or>>the<<end>><<end>> <<one>>creative commons attribution<<or>>cc by<<end>> <<one>>1 0<<or>>2 0<<or>>2 5<<or>>3 0<<or>>4 0<<end>> <<opt>>international<<end>> <<opt>>license<<end>>"),
    (
        "cc-by-sa",
        f"{_UNDER} <<opt>><<one>>a<<or>>the<<end>><<end>> <<one>>creative commons attribution <<one>>sharealike<<or>>share alike<<end>><<or>>cc by sa<<end>> <<one>>1 0<<or>>2 0<<or>>2 5<<or>>3 0<<or>>4 0<<end>> <<opt>>international<<end>> <<opt>>license<<end>>",
    ),
    (
        "cc-by-nc",
        f"{_UNDER} <<opt>><<one>>a<<or>>the<<end>><<end>> <<one>>creative commons attribution <<one>>noncommercial<<or>>non commercial<<end>><<or>>cc by nc<<end>> <<one>>1 0<<or>>2 0<<or>>2 5<<or>>3 0<<or>>4 0<<end>> <<opt>>international<<end>> <<opt>>license<<end>>",
    ),
    (
        "cc-by-nd",
        f"{_UNDER} <<opt>><<one>>a<<or>>the<<end>><<end>> <<one>>creative commons attribution <<one>>noderivatives<<or>>no derivatives<<or>>noderivs<<end>><<or>>cc by nd<<end>> <<one>>1 0<<or>>2 0<<or>>2 5<<or>>3 0<<or>>4 0<<end>> <<opt>>international<<end>> <<opt>>license<<end>>",
    ),
    ("rights-notice", "copyright <<any 8>> all rights reserved"),
)

# A notice directly after one of these words says the opposite.
DENIED_BY = ("not", "never", "nor", "neither")
