"""Licence templates: notices as they stand in file headers, and whole texts of the short licences."""

#: name, template text, mandatory key phrases; "..." in a text stands for any number of other words
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license version 2 0"]),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', ["apache license version 2 0", "in compliance with the license"]),
    ("MIT", "Released under the MIT License.", ["mit license"]),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license version 3"]),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public license", "either version 3 of the license or at your option any later version"]),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public license", "either version 2 of the license or at your option any later version"]),
    ("LGPL-2.1-or-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ["gnu lesser general public license", "either version 2 1 of the license"]),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: ... Neither the name of ... nor the names of its contributors may be used", ["redistribution and use in source and binary forms", "neither the name of", "nor the names of"]),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license v 2 0"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0 international"]),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived all copyright and related or neighboring rights"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software released into the public domain"]),
    ("proprietary", "All rights reserved.", ["all rights reserved"]),
]

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: ... Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. ... Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """... BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL ... BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: whole texts; what holders fill in is left out
TEXTS = [
    ("MIT (text)", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
    use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
    Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
    shall be included in all copies or substantial portions of the Software. """ + _AS_IS, ["permission is hereby granted free of charge", "shall be included in all copies or substantial portions of the software", "the software is provided as is"]),
    ("BSD-2-Clause (text)", _BSD_HEAD + _BSD_TAIL, ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "even if advised of the possibility of such damage"]),
    ("BSD-3-Clause (text)", _BSD_HEAD + """ ... Neither the name of ... nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission. """ + _BSD_TAIL, ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "nor the names of its contributors", "even if advised of the possibility of such damage"]),
    ("ISC (text)", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
    IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
    ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ["with or without fee is hereby granted", "this permission notice appear in all copies"]),
    ("0BSD (text)", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""", ["with or without fee is hereby granted the software is provided as is"]),
    ("Zlib (text)", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
    liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
    purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
    1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
    this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
    source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
    not be removed or altered from any source distribution.""", ["must not be misrepresented as being the original software", "this notice may not be removed or altered from any source distribution"]),
    ("BSL-1.0 (text)", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any
    person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
    to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and
    to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the
    Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be
    included in all copies of the Software""", ["boost software license version 1 0", "to any person or organization obtaining a copy"]),
    ("Unlicense (text)", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
    publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
    software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of
    the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
    relinquishment in perpetuity of all present and future rights to this software under copyright law. """ + _AS_IS, ["free and unencumbered software released into the public domain", "relinquishment in perpetuity of all present and future rights"]),
]
