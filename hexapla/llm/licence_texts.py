"""What the licence classifier learns from: wordings of notices by family, full permission texts, notices of licences outside of
the families, and prose that uses the same words without granting anything. Notices of fixed wording are fixed values; the rest is own text."""

from __future__ import annotations

#: Notices by family; {} stands for a name or a year.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license", "Distributed under the terms of the Apache License 2.0", "You may obtain a copy of the Apache License at www.apache.org/licenses/LICENSE-2.0", "The code is made available under Apache License v2",
    ],
    "mit": ["Released under the MIT License", "SPDX-License-Identifier: MIT", "Licensed under the MIT license", "This code is available under the terms of the MIT License", "MIT licensed", "The MIT License (MIT)", "Use of this package is governed by the MIT license"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL version 3 license", "Licensed under the GPLv3 license", "GNU General Public License v3.0",
        "either version 3 of the GNU General Public License, or any later version", "Lizenziert unter der GNU General Public License Version 3", "Distributed under the GNU General Public License 3",
    ],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GNU GPL version 2 license", "Licensed under the GPLv2 license", "GNU General Public License v2.0", "either version 2 of the GNU General Public License, or any later version"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-3.0-or-later", "This library is released under the LGPL license", "You can redistribute this library under the terms of the GNU Lesser General Public License", "GNU Lesser General Public License v3"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "This service is released under the AGPL license", "under the terms of the GNU Affero General Public License"],
    "bsd": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license", "Released under the BSD 2-Clause license", "Distributed under the terms of the BSD license"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Released under the Mozilla Public License 2.0", "Licensed under the Mozilla Public License version 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons BY-NC-SA license", "Released under the CC BY-NC-ND 4.0 licence", "Published under CC BY-NC 3.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the CC BY-SA 3.0 licence", "Creative Commons Attribution-ShareAlike License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Released under a CC BY licence", "Published under the Creative Commons Attribution License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0", "To the extent possible under law the author has waived all copyright under CC0", "Released under the CC0 public domain licence", "This is free and unencumbered software released into the public domain"],
    "proprietary": ["Copyright {} {}. All rights reserved", "All rights reserved", "All rights reserved. No part of this work may be reproduced without permission of the publisher", "This software is proprietary and its license forbids redistribution", "Alle Rechte vorbehalten", "Todos los derechos reservados", "Tous droits réservés"],
}

#: Passages of the fixed texts themselves, long enough to be told from others.
FULL = {
    "apache-2.0": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0"],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}

#: Names of the families, put into the forms of `GRANTS`.
NAMES = {
    "apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"], "mit": ["MIT", "MIT License"], "gpl-3.0": ["GPLv3", "GPL 3", "GNU GPL version 3", "GNU General Public License version 3"], "gpl-2.0": ["GPLv2", "GPL 2", "GNU GPL version 2", "GNU General Public License version 2"],
    "lgpl": ["LGPL", "LGPL 2.1", "GNU Lesser General Public License"], "agpl-3.0": ["AGPL", "AGPL 3.0", "GNU Affero GPL"], "bsd": ["BSD", "BSD 3-Clause", "BSD License"], "mpl-2.0": ["MPL 2.0", "Mozilla Public License 2.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0"], "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0"], "cc-by": ["CC BY 4.0", "CC BY 3.0"], "cc0": ["CC0 1.0", "CC0"],
}
GRANTS = [
    "Distributed under the {}", "Licensed under {}", "This work is licensed under the {}", "Source code: {}", "Published under {}", "Made available under the terms of the {}", "License: {}", "Released under the {}", "Lizenz: {}", "Veröffentlicht unter {}", "Lizenziert unter der {}", "Dieses Werk steht unter der {}",
    "Licencia: {}", "Publicado bajo {}", "Licencia {}", "Licence : {}", "Publié sous {}", "Distribué sous la licence {}",
]
#: Names that stand alone; others are words of common use.
ALONE = ["Apache License 2.0", "GPLv3", "GNU General Public License version 3", "GPLv2", "GNU General Public License version 2", "LGPL 2.1", "AGPL 3.0", "BSD 3-Clause", "BSD License", "MIT License", "Mozilla Public License 2.0", "CC BY-NC 4.0", "CC BY-SA 4.0", "CC BY 4.0", "CC0 1.0"]

#: Licences that aren't of the families: these are learned, those of OTHERS_HELD only measured.
OTHERS = ["zlib License", "ISC License", "Unlicense", "WTFPL", "Boost Software License 1.0", "PostgreSQL License", "Microsoft Public License", "Open Software License 3.0", "Academic Free License", "Python Software Foundation License", "Open Database License", "SIL Open Font License 1.1", "GNU Free Documentation License 1.3", "Business Source License 1.1"]
OTHERS_HELD = ["Eclipse Public License 2.0", "European Union Public Licence 1.2", "Artistic License 2.0", "Common Development and Distribution License", "Server Side Public License", "Elastic License 2.0", "Q Public License"]

#: Forms that name a licence and grant nothing.
MENTIONS = [
    "This text is NOT licensed under {}", "NOT licensed under {}", "The archive is no longer released under the {}", "It was never distributed under {}", "Do not publish it under {}", "Nicht veröffentlicht unter {}", "Das Werk steht nicht unter der {}",
    "The author compares the {} with the {} and finds neither better", "A lawyer explained how the {} differs from the {}", "Students discussed whether the {} is better than the {}", "What does the {} say about patents", "The history of the {} began long ago", "Many people prefer the {} to the {}",
    "Er verglich die {} mit der {}", "She wrote an essay about the {}", "Is it compatible with the {} or not",
]

#: Prose with the same words that grants nothing.
PROSE = [
    "She lost her driving license near the bridge last week", "The committee discussed copyright in general terms", "Ask the owner for permission before you enter the field", "The warrant was signed by a judge in the morning", "He carries a fishing licence for the lake", "Wealth was redistributed among the villages",
    "Permission to land was given by the tower", "The warranty of the kettle ended in March", "The poet took some license with the dates", "A licensed plumber repaired the pipes", "Copyright law is taught in the second year", "They applied for a licence to sell wine and beer", "The taxi license costs more each year",
    "No permission was asked and none was given", "She studies the public domain in economics", "The restaurant is fully licensed and open until late", "Creative commons rooms are open to all students", "You need written permission from your parents", "The police had no warrant to search the house", "Heat is redistributed by the ocean",
    "Licence fees for television went up", "The license of the pilot was renewed in version two of the form", "Er kam mit dem Zug und mit der Tasche", "Mit freundlichen Grüßen", "Sie sprach mit einer Frau mit Hut", "Eine Lizenz mit dem Namen des Fahrers", "MIT DEM HUND UND MIT DER KATZE UNTER DIE BRÜCKE", "She studied physics at MIT in Boston",
    "Our MIT colleagues hold a driving licence", "Graduates of MIT were released from the exam", "He got a degree from MIT", "MIT is in Cambridge and its code of honour is old", "The Apache lived in the plains of the west", "An Apache helicopter crossed the valley", "Version 2 of the Apache helicopter was licensed to a builder abroad",
    "The book was written by a friend of the public", "Three forms of the binary star in one source", "The general public has 3 doors and 2 gates", "A gnu stood by the river with 2 or 3 others", "Entry is free of charge and without restriction", "The seats are reserved and all rights of way were kept", "They sent cc by mail to the office",
    "The creative attribution of the commons was discussed", "The house came into the public domain of the town", "A proprietary recipe of the baker", "The table was reserved for two by the general", "Mozilla met the public in the square", "He was released under guard", "The prisoners were released under the amnesty", "It was published under a false name",
    "Das Kind spielte mit 2 Freunden und 3 Katzen", "Er wurde unter der Brücke gefunden", "Published under the title of the first chapter", "Distributed under the trees", "The source code of the machine was lost", "Software is distributed over many rooms", "The terms of the treaty were published", "La licencia de conducir fue renovada", "Le permis et la licence de pêche",
    "Die Lizenz des Piloten wurde erneuert", "Las puertas del reino bajo la lluvia", "Sous la pluie et sous le pont", "All rights of the workers were discussed", "Human rights are reserved for nobody", "The file is a tool to smooth metal",
]
