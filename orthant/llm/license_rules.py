"""The ordered signature rules: one hand-written pattern a line, in blocks of falling priority.

A line of a block has a label, the keyword that gates the rule, and a pattern. Patterns are matched against the lower-cased
words of a text joined by single spaces (so `2.0` reads `2 0` and an address is a row of words), begin and end at
words, and are tried only where the keyword is one of the text's words. Within a block longer detections come
first; a detection that lies within an earlier one is suppressed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Whole sentences of licence texts and headers that name a licence with its version.
TEXTS = r"""
mit                permission      permission is hereby granted free of charge to any person obtaining a copy of this software
mit                copies          the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0              permission      permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc                permission      permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd               permission      permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd               permission      permission to use copy modify and distribute this software and its documentation for any purpose
x11                consortium      the name of the x consortium shall not be used in advertising
ntp                suitability     makes no representations about the suitability of this software for any purpose it is provided as is
bsd-2-clause       binary          redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd                redistribution  redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause       endorse         neither the name of .{1,80}? may be used to endorse or promote products derived from this software
bsd-4-clause       advertising     all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib               misrepresented  the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib               altered         altered source versions must be plainly marked as such
unlicense          unencumbered    this is free and unencumbered software released into the public domain
wtfpl              fuck            you just do what the fuck you want to
bsl-1.0            boost           boost software license version 1 0(?: august 17th 2003)?
apache-2.0         apache          licensed under the apache license version 2 0(?: the license)?
apache-2.0         licenses        apache org licenses license 2 0(?: txt| html)?
apache-2.0         apache          apache license version 2 0 january 2004
apache-1.1         apache          (?:the )?apache software license version 1 1
apache-1.0         apache          this product includes software developed by the apache group
gpl-1.0            gnu             gnu general public license version 1 february 1989
gpl-2.0            gnu             gnu general public license version 2 june 1991
gpl-3.0            gnu             gnu general public license version 3 29 june 2007
gpl-2.0-or-later   redistribute    redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later   redistribute    redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only       redistribute    redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3.0-only       redistribute    redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation
gpl                redistribute    redistribute it and or modify it under the terms of the gnu general public license
lgpl-2.1-or-later  redistribute    redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later  redistribute    redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later  library         redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later  affero          redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later   gnu             gnu general public license version 2 or (?:at your option )?(?:any )?later
gpl-3.0-or-later   gnu             gnu general public license version 3 or (?:at your option )?(?:any )?later
fdl-1.1            documentation   gnu free documentation license version 1 1 or any later version
fdl-1.2            documentation   gnu free documentation license version 1 2 or any later version
fdl-1.3            documentation   gnu free documentation license version 1 3 or any later version
classpath          linking         linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception      runtime         gcc runtime library exception(?: version 3 1)?
mpl-1.1            mozilla         subject to the mozilla public license version 1 1
mpl-2.0            mozilla         this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0            mozilla         if a copy of the mpl was not distributed with this file you can obtain one at http(?:s)? mozilla org mpl 2 0
epl-1.0            eclipse         made available under the terms of the eclipse public license v1 0
epl-2.0            eclipse         made available under the terms of the eclipse public license 2 0
edl-1.0            eclipse         made available under the terms of the eclipse distribution license v1 0
cddl-1.0           distribution    subject to the terms of the common development and distribution license
cpl-1.0            common          made available under the terms of the common public license v1 0
ms-pl              governs         this license governs use of the accompanying software if you use the software you accept this license
artistic-1.0       intent          the intent of this document is to state the conditions under which a package may be copied
gnu-text           verbatim        everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
perl               perl            you can redistribute it and or modify it under the same terms as perl itself
ruby               bsdl            you can redistribute it and or modify it under either the terms of the 2 clause bsdl
python-2.0         python          python software foundation license version 2
php-3.01           php             this source file is subject to version 3 01 of the php license
php-3.0            php             this source file is subject to version 3 0+ of the php license
openssl            openssl         this product includes software developed by the openssl project for use in the openssl toolkit
ssleay             young           this product includes cryptographic software written by eric young
postgresql         california      in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
curl               granted         permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
libpng             png             the png reference library is supplied as is
ijg                jpeg            this software is based in part on the work of the independent jpeg group
info-zip           info            this software is provided as is without warranty of any kind express or implied in no event shall info zip
bzip2-1.0.6        bzip2           this program bzip2 the associated library libbzip2
sqlite             blessing        the author disclaims copyright to this source code in place of a legal notice here is a blessing
beerware           beer            if we meet some day and you think this stuff is worth it you can buy me a beer in return
json               evil            the software shall be used for good not evil
ofl-1.1            font            this font software is licensed under the sil open font license version 1 1
cc0-1.0            waived          has waived all copyright and related or neighboring rights to this work
cc0-1.0            dedicated       the person who associated a work with this deed has dedicated the work to the public domain
public-domain      domain          this (?:work|file|software|code|document|text) is (?:hereby )?(?:released|dedicated|placed)(?: in| into| to)? the public domain
public-domain      domain          (?:i|we) (?:hereby )?(?:release|dedicate|place) this (?:work|file|software|code) (?:in|into|to) the public domain
us-government      government      this is a work of the (?:u s|us|united states) government
sspl-1.0           server          licensed under the server side public license(?: v1| version 1)?
elastic-2.0        elastic         licensed under the elastic license 2 0
busl-1.1           change          on the change date or the fourth anniversary of the first publicly available distribution
commons-clause     sell            the license does not grant to you the right to sell the software
llama2             llama           llama 2 is licensed under the llama 2 community license
openrail           rail            licensed under the (?:creativeml |bigscience )?open rail(?: m)? license
rail-bloom         bigscience      bigscience rail license v1 0
no-warranty        warranty        the software is provided as is without warranty of any kind express or implied
no-warranty        warranty        this program is distributed in the hope that it will be useful but without any warranty
no-warranty        warranties      provided by the copyright holders and contributors as is and any express or implied warranties
proprietary        proprietary     this (?:software|document|file|work) (?:is|contains) (?:the )?confidential and proprietary(?: information)?
proprietary        proprietary     this (?:software|document|file|work) (?:is|contains) (?:the )?proprietary and confidential(?: information)?
proprietary        reproduced      no part of this (?:publication|book|work|document) may be reproduced
proprietary        permission      (?:may not be|not to be) (?:copied|reproduced|distributed|published|broadcast|rewritten)(?: or redistributed)? without (?:the )?(?:prior )?(?:express )?(?:written )?permission
non-commercial     commercial      for (?:personal and )?non commercial use only
non-commercial     noncommercial   for (?:personal and )?noncommercial use only
"""
#: Licences named with their version, in words, as an identifier or by address.
VERSIONS = r"""
gpl-1.0            gnu             gnu general public license (?:v|version )?1(?: 0)?(?: only| or later)?
gpl-2.0            gnu             gnu general public license(?: gpl)? (?:v|version )?2(?: 0)?(?: only)?
gpl-3.0            gnu             gnu general public license(?: gpl)? (?:v|version )?3(?: 0)?(?: only)?
gpl-2.0            gpl             gpl (?:v|version )?2(?: 0)?(?: only)?
gpl-3.0            gpl             gpl (?:v|version )?3(?: 0)?(?: only)?
gpl-2.0-or-later   gpl             gpl 2 0 or later
gpl-3.0-or-later   gpl             gpl 3 0 or later
gpl-2.0            gplv2           gplv2
gpl-3.0            gplv3           gplv3
gpl-2.0            licenses        gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0            licenses        gnu org licenses gpl 3 0(?: html| txt)?
lgpl-2.0           library         gnu library general public license (?:v|version )?2(?: 0)?(?: only| or later)?
lgpl-2.1           lesser          gnu lesser general public license (?:v|version )?2 1(?: only| or later)?
lgpl-3.0           lesser          gnu lesser general public license (?:v|version )?3(?: 0)?(?: only| or later)?
lgpl-2.1           lgpl            lgpl (?:v|version )?2 1(?: only| or later)?
lgpl-3.0           lgpl            lgpl (?:v|version )?3(?: 0)?(?: only| or later)?
lgpl-3.0           lgplv3          lgplv3
agpl-1.0           affero          affero general public license (?:v|version )?1(?: 0)?
agpl-3.0           affero          (?:gnu )?affero general public license (?:v|version )?3(?: 0)?(?: only| or later)?
agpl-3.0           agpl            agpl (?:v|version )?3(?: 0)?(?: only| or later)?
agpl-3.0           agplv3          agplv3
fdl-1.1            documentation   gnu free documentation license (?:v|version )?1 1
fdl-1.2            documentation   gnu free documentation license (?:v|version )?1 2
fdl-1.3            documentation   gnu free documentation license (?:v|version )?1 3
fdl-1.3            gfdl            gfdl (?:v|version )?1 3
apache-1.0         apache          apache(?: software)? license (?:v|version )?1(?: 0)?
apache-1.1         apache          apache(?: software)? license (?:v|version )?1 1
apache-2.0         apache          (?:the )?apache(?: software)? license (?:v|version )?2(?: 0)?
apache-2.0         apache          apache 2 0
apache-2.0         asl             asl 2 0
mpl-1.0            mozilla         mozilla public license (?:v|version )?1(?: 0)?
mpl-1.1            mozilla         mozilla public license (?:v|version )?1 1
mpl-2.0            mozilla         mozilla public license (?:v|version )?2(?: 0)?
mpl-1.1            mpl             mpl 1 1
mpl-2.0            mpl             mpl 2 0
epl-1.0            eclipse         eclipse public license (?:v ?|version )?1(?: 0)?
epl-2.0            eclipse         eclipse public license (?:v ?|version )?2(?: 0)?
epl-1.0            epl             epl 1 0
epl-2.0            epl             epl 2 0
cddl-1.0           cddl            cddl 1 0
cddl-1.1           cddl            cddl 1 1
cddl-1.0           distribution    common development and distribution license(?: cddl)? (?:v|version )?1 0
cddl-1.1           distribution    common development and distribution license(?: cddl)? (?:v|version )?1 1
cpl-1.0            common          common public license (?:v|version )?1(?: 0)?
eupl-1.1           eupl            eupl (?:v|version )?1 1
eupl-1.2           eupl            eupl (?:v|version )?1 2
eupl-1.1           european        european union public licen[cs]e (?:v|version )?1 1
eupl-1.2           european        european union public licen[cs]e (?:v|version )?1 2
osl-1.0            open            open software license (?:v|version )?1 0
osl-2.1            open            open software license (?:v|version )?2 1
osl-3.0            open            open software license (?:v|version )?3(?: 0)?
afl-2.1            academic        academic free license (?:v|version )?2 1
afl-3.0            academic        academic free license (?:v|version )?3(?: 0)?
artistic-1.0       artistic        artistic license (?:v|version )?1(?: 0)?
artistic-2.0       artistic        artistic license (?:v|version )?2(?: 0)?
cecill-1.0         cecill          cecill(?: free software)? license (?:v|version )?1(?: 0)?
cecill-2.0         cecill          cecill(?: free software)? license (?:v|version )?2(?: 0)?
cecill-2.1         cecill          cecill(?: free software)? license (?:v|version )?2 1
cecill-b           cecill          cecill b
cecill-c           cecill          cecill c
bsl-1.0            bsl             bsl 1 0
busl-1.1           business        business source license (?:v|version )?1 1
busl-1.1           busl            busl 1 1
sspl-1.0           sspl            sspl (?:v|version )?1(?: 0)?
zpl-2.0            zope            zope public license(?: zpl)? (?:v|version )?2 0
zpl-2.1            zope            zope public license(?: zpl)? (?:v|version )?2 1
php-3.01           php             php license (?:v|version )?3 01
php-3.0            php             php license (?:v|version )?3(?: 0)?
ofl-1.0            ofl             ofl (?:v|version )?1 0
ofl-1.1            ofl             ofl (?:v|version )?1 1
ofl-1.1            font            sil open font license (?:v|version )?1 1
odbl-1.0           odbl            odbl (?:v|version )?1 0
odbl-1.0           database        open (?:data commons open )?database license(?: odbl)? (?:v|version )?1 0
odc-by-1.0         attribution     open data commons attribution license(?: odc by)? (?:v|version )?1 0
pddl-1.0           pddl            pddl(?: 1 0)?
upl-1.0            permissive      universal permissive license (?:v|version )?1 0
mulan-1.0          mulan           mulan (?:psl|permissive software license) (?:v|version )?1
mulan-2.0          mulan           mulan (?:psl|permissive software license) (?:v|version )?2
wtfpl-2            fuck            do what the fuck you want to public license version 2
cc0-1.0            cc0             cc0 1 0(?: universal)?
cc0-1.0            publicdomain    creativecommons org publicdomain zero 1 0
cc-pdm-1.0         publicdomain    creativecommons org publicdomain mark 1 0
cc-by-1.0          cc              cc by 1 0
cc-by-2.0          cc              cc by 2 0
cc-by-2.5          cc              cc by 2 5
cc-by-3.0          cc              cc by 3 0
cc-by-4.0          cc              cc by 4 0
cc-by-sa-1.0       cc              cc by sa 1 0
cc-by-sa-2.0       cc              cc by sa 2 0
cc-by-sa-2.5       cc              cc by sa 2 5
cc-by-sa-3.0       cc              cc by sa 3 0
cc-by-sa-4.0       cc              cc by sa 4 0
cc-by-nd-3.0       cc              cc by nd 3 0
cc-by-nd-4.0       cc              cc by nd 4 0
cc-by-nc-2.0       cc              cc by nc 2 0
cc-by-nc-3.0       cc              cc by nc 3 0
cc-by-nc-4.0       cc              cc by nc 4 0
cc-by-nc-sa-2.0    cc              cc by nc sa 2 0
cc-by-nc-sa-3.0    cc              cc by nc sa 3 0
cc-by-nc-sa-4.0    cc              cc by nc sa 4 0
cc-by-nc-nd-3.0    cc              cc by nc nd 3 0
cc-by-nc-nd-4.0    cc              cc by nc nd 4 0
cc-by-2.0          creativecommons creativecommons org licenses by 2 0
cc-by-3.0          creativecommons creativecommons org licenses by 3 0
cc-by-4.0          creativecommons creativecommons org licenses by 4 0
cc-by-sa-3.0       creativecommons creativecommons org licenses by sa 3 0
cc-by-sa-4.0       creativecommons creativecommons org licenses by sa 4 0
cc-by-nd-4.0       creativecommons creativecommons org licenses by nd 4 0
cc-by-nc-4.0       creativecommons creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0    creativecommons creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0    creativecommons creativecommons org licenses by nc nd 4 0
cc-by-2.0          attribution     creative commons attribution 2 0(?: generic| unported)?(?: license)?
cc-by-3.0          attribution     creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-4.0          attribution     creative commons attribution 4 0(?: international)?(?: license)?
cc-by-sa-3.0       attribution     creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-sa-4.0       attribution     creative commons attribution share ?alike 4 0(?: international)?(?: license)?
cc-by-nd-4.0       attribution     creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?
cc-by-nc-3.0       attribution     creative commons attribution non ?commercial 3 0(?: unported)?(?: license)?
cc-by-nc-4.0       attribution     creative commons attribution non ?commercial 4 0(?: international)?(?: license)?
cc-by-nc-sa-3.0    attribution     creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: license)?
cc-by-nc-sa-4.0    attribution     creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0    attribution     creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?
bsd-1-clause       bsd             bsd 1 clause(?: license)?
bsd-2-clause       bsd             bsd 2 clause(?: license)?
bsd-3-clause       bsd             bsd 3 clause(?: license)?
bsd-4-clause       bsd             bsd 4 clause(?: license)?
bsd-2-clause       bsd             (?:2|two) clause bsd(?: license)?
bsd-3-clause       bsd             (?:3|three) clause bsd(?: license)?
bsd-2-clause       simplified      simplified bsd license
bsd-3-clause       revised         revised bsd license
bsd-3-clause       modified        modified bsd license
bsd-2-clause       freebsd         freebsd license
mit                spdx            spdx license identifier mit
isc                spdx            spdx license identifier isc
zlib               spdx            spdx license identifier zlib
unlicense          spdx            spdx license identifier unlicense
bsd-3-clause       spdx            spdx license identifier bsd 3 clause
bsd-2-clause       spdx            spdx license identifier bsd 2 clause
apache-2.0         spdx            spdx license identifier apache 2 0
gpl-2.0            spdx            spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later   spdx            spdx license identifier gpl 2 0 or later
gpl-3.0            spdx            spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later   spdx            spdx license identifier gpl 3 0 or later
lgpl-2.1           spdx            spdx license identifier lgpl 2 1(?: only| or later)?
agpl-3.0           spdx            spdx license identifier agpl 3 0(?: only| or later)?
mpl-2.0            spdx            spdx license identifier mpl 2 0
epl-2.0            spdx            spdx license identifier epl 2 0
cc0-1.0            spdx            spdx license identifier cc0 1 0
mit                opensource      opensource org licenses mit(?: license)?(?: php)?
bsd-3-clause       opensource      opensource org licenses bsd 3 clause
isc                opensource      opensource org licenses isc
unlicense          unlicense       unlicense org
wtfpl              wtfpl           wtfpl net
"""
#: Licences named without a version.
NAMES = r"""
gpl                gnu             gnu general public license
gpl                gnu             gnu gpl
gpl                gpl             (?:under|the) gpl(?: license)?
gpl                gpl             gpl license
lgpl               lesser          gnu lesser general public license
lgpl               library         gnu library general public license
lgpl               lgpl            (?:gnu )?lgpl
agpl               affero          (?:gnu )?affero general public license
agpl               agpl            (?:gnu )?agpl
fdl                documentation   gnu free documentation license
fdl                gfdl            (?:gnu )?gfdl
apache             apache          (?:the )?apache(?: software)? license
apache             apache          apache style license
mpl                mozilla         mozilla public license
epl                eclipse         eclipse public license
edl                eclipse         eclipse distribution license
cddl               distribution    common development and distribution license
cpl                common          common public license
ibmpl              ibm             ibm public license
eupl               european        european union public licen[cs]e
osl                open            open software license
afl                academic        academic free license
artistic           artistic        artistic license
cecill             cecill          cecill(?: free software)? license
bsl                boost           boost software license
busl               business        business source license
sspl               server          server side public license
elastic            elastic         elastic license
confluent          confluent       confluent community license
zpl                zope            zope public license
python             python          python software foundation license
php                php             php license
ruby               ruby            ruby license
perl               perl            perl artistic license
openssl            openssl         openssl license
postgresql         postgresql      postgresql license
ofl                font            (?:sil )?open font license
odbl               database        open database license
odbl               odbl            odbl
odc-by             attribution     open data commons attribution license
upl                permissive      universal permissive license
mulan              mulan           mulan (?:psl|permissive software license)
mit                mit             (?:the )?mit license
mit                mit             mit style license
mit                mit             (?:licensed|released|distributed|available) under (?:the )?mit
mit                expat           expat license
x11                x11             x11 license
isc                isc             (?:the )?isc license
isc                isc             (?:licensed|released|distributed|available) under (?:the )?isc
zlib               zlib            zlib(?: libpng)? license
bsd                bsd             (?:the )?bsd license
bsd                bsd             bsd style license
bsd                bsd             (?:licensed|released|distributed|available) under (?:the )?bsd
unlicense          unlicense       the unlicense
wtfpl              wtfpl           wtfpl
wtfpl              fuck            do what the fuck you want to public license
ncsa               illinois        university of illinois(?: ncsa)? open source license
ms-pl              microsoft       microsoft public license
ms-rl              microsoft       microsoft reciprocal license
nasa               nasa            nasa open source agreement
qpl                qpl             qpl
qpl                public          q public license
sleepycat          sleepycat       sleepycat license
vim                vim             vim license
beerware           beer            beer(?: ware)? license
beerware           beerware        beerware license
llama              llama           llama(?: 2| 3)? community license
openrail           openrail        openrail(?: m)?
cc0                cc0             cc0
cc0                zero            creative commons zero
cc-by              cc              cc by(?! (?:sa|nd|nc)\b)
cc-by-sa           cc              cc by sa
cc-by-nd           cc              cc by nd
cc-by-nc           cc              cc by nc(?! (?:sa|nd)\b)
cc-by-nc-sa        cc              cc by nc sa
cc-by-nc-nd        cc              cc by nc nd
cc-by              attribution     creative commons attribution(?: license)?(?! (?:share|no|non))
cc-by-sa           attribution     creative commons attribution share ?alike
cc-by-nd           attribution     creative commons attribution no ?deriv(?:ative)?s
cc-by-nc           attribution     creative commons attribution non ?commercial
cc                 creative        creative commons license
public-domain      domain          (?:in|into|to) the public domain
public-domain      domain          public domain dedication
"""
#: Notices that grant nothing by themselves.
NOTICES = r"""
proprietary        rights          all rights reserved
proprietary        proprietary     proprietary and confidential
proprietary        proprietary     proprietary license
proprietary        unauthorized    unauthorized (?:copying|use|reproduction|distribution)
no-warranty        warranty        (?:provided )?as is without (?:any )?warranty
no-warranty        warranties      without warranties or conditions of any kind
free-software      free            free software license
open-source        open            open source license
copyleft           copyleft        copyleft license
"""


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules in order of priority; 0 is the strongest."""
    lines = ((p, *line.split(None, 2)) for p, block in enumerate((TEXTS, VERSIONS, NAMES, NOTICES)) for line in block.strip().splitlines())
    return [Rule(p, label, keyword, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)")) for p, label, keyword, pattern in lines]
