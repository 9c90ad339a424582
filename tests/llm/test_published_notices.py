import pytest

from tests.llm.test_licenses import SCANNER, labels


@pytest.mark.parametrize(("text", "wanted"), [
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004", "wtfpl"),
    ("https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html", "lgpl-2.1"),
    ("https://www.gnu.org/licenses/agpl-3.0.html", "agpl-3.0"),
    ("http://www.ibm.com/developerworks/library/os-cpl.html", "cpl-1.0"),
    ("under the same terms as Perl itself", "perl"),
    ("https://creativecommons.org/publicdomain/zero/1.0/legalcode", "cc-zero"),
    ("http://creativecommons.org/licenses/by/4.0/", "cc-by-url"),
    ("https://opendatacommons.org/licenses/odbl/1-0/", "odc-url"),
    ("Licensed to PSF under a Contributor Agreement.", "python-2.0"),
    ("https://docs.python.org/3/license.html", "psf"),
    ("Corporation for National Research Initiatives", "cnri-python"),
    ("This product includes cryptographic software written by Eric Young (eay@cryptsoft.com)", "ssleay"),
    ("https://www.w3.org/Consortium/Legal/2015/copyright-software-and-document", "w3c"),
    ("http://scripts.sil.org/OFL", "ofl"),
    ("http://www.ijg.org", "ijg"),
    ("https://mariadb.com/bsl11/", "bsl-1.1"),
    ("https://polyformproject.org/licenses/noncommercial/1.0.0", "polyform-nc"),
    ("https://firstdonoharm.dev", "hippocratic"),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"),
])
def test_published_forms(text, wanted):
    assert wanted in labels(f"before {text} after")


def test_keywords_are_not_part_of_patterns():
    assert all(" => " not in r.pattern.pattern.decode() and "=>" not in r.keyword for r in SCANNER.rules)
