"""Secrets behind assignments: a labelled fixture, constants and scopes, and work in proportion to the text."""

import time

import pytest

from stepwise.llm import secret_scan
from stepwise.llm.assignments import lexed

#: Texts whose literals between the signs « and » are secrets.
LABELLED = [
    "db_pass = '«Zx81kQpLw09s»'", "pin_code='«Zx81kQpLw09s»'", "pwd = get('«Zx81kQpLw09s»')", 'password = """«Zx81kQpLw09s»"""', "password = '«Zx81kQ»' + '«pLw09s»'",
    "A = '«Zx81kQ»'\npassword = A + '«pLw09s»'", "<password>«Zx81kQpLw09s»</password>", "postgres://app:«Zx81kQpLw09s»@db.example.org/x", "mysql --password «Zx81kQpLw09s» -h db",
    '#define API_KEY "«Zx81kQpLw09s»"', "password: str = '«Zx81kQpLw09s»'", "def f(password: Optional[str] = '«Zx81kQpLw09s»'): pass", 'String dbPassword = "«Zx81kQpLw09s»";',
    "const char *secret = \"«Zx81kQpLw09s»\";", "config['db']['password'] = '«Zx81kQpLw09s»'", 'os.environ["AUTH_TOKEN"] = "«Zx81kQpLw09s»"', "token = os.getenv('AUTH_TOKEN', '«Zx81kQpLw09s»')",
    "const secret = process.env.SECRET || '«Zx81kQpLw09s»'", "if password == '«Zx81kQpLw09s»': pass", "# password = '«Zx81kQpLw09s»'", "/* token: \"«Zx81kQpLw09s»\" */", 'x = {"password": "«Zx81kQpLw09s»"}',
    'log("{\\"password\\": \\"«Zx81kQpLw09s»\\"}")', 'c = "Server=h;Password=«Zx81kQpLw09s»;User=u"', "- name: DB_PASSWORD\n  value: «Zx81kQpLw09s»\n", '<add key="ApiKey" value="«Zx81kQpLw09s»"/>',
    "K = '«Zx81kQpLw09s»'\nexport TOKEN=$K", "a = '«Zx81kQpLw09s»'\nb = a\nc = b\nclient_secret = c", "password = ('«Zx81kQ»'\n  '«pLw09s»')", "private_key = r'«Zx81kQpLw09s»'", "passphrase: «Zx81kQpLw09s»\n",
    "user_pass := `«Zx81kQpLw09s»`", "$password = b64decode('«Zx81kQpLw09s»');", "signing_key => '«Zx81kQpLw09s»'", "it's here: don't lose password = '«Zx81kQpLw09s»'", "def f():\n  k = 'just words'\n  return k\nk = '«Zx81kQpLw09s»'\nsecret = k",
    "secret_santa: wonderful_evening_2024", "token_count = 123456789", "max_tokens: 4096000", "password_length = 'sixteen characters'", "password = user_password", "password: required", "key = 'Zx81kQpLw09s'",
    "password = getpass('Your password: ')", "token = os.environ['AUTH_TOKEN']", "token = os.getenv('AUTH_TOKEN')", "password = '<your password>'", "password = '${DB_PASSWORD}'", "password=$DB_PASSWORD", "secret = None",
    "def f():\n  k = 'Zx81kQpLw09s'\n  return k\nsecret = k", "function f() { k = 'Zx81kQpLw09s' }\nfunction g() { secret = k }", "first_pass: linear_scan_phase2", "the password: see page 12", "spinner = 'Zx81kQpLw09s'",
    "https://example.org/a:b@c", "password != 'Zx81kQpLw09s'", "passenger = 'Zx81kQpLw09s'", "author: 'Zx81kQpLw09s'", "password = 'xxxxxxxxxx'", "name: Zx81kQpLw09s\nvalue: other",
]


def labelled(text):
    spans, plain, start = set(), "", 0
    for c in text:
        if c == "«":
            start = len(plain)
        elif c == "»":
            spans.add((start, len(plain)))
        else:
            plain += c
    return plain, spans


def test_labelled_secrets_precision_and_recall():
    found, right, wanted, wrong = 0, 0, 0, []
    for text in LABELLED:
        plain, want = labelled(text)
        got = secret_scan.literal_spans(plain)
        found, right, wanted = found + len(got), right + len(got & want), wanted + len(want)
        if got != want:
            wrong.append((plain, got, want))
    print(f"precision {right / found:.3f} recall {right / wanted:.3f}", wrong)
    assert right / found >= 0.9 and right / wanted >= 0.9, wrong


@pytest.mark.parametrize("bit", [
    "password='", 'password="', 'password="\\', "password=`", "{password=a", "}password=a{", "password='''", 'password="""', "password=b+", "token = token + 'x'\n", "a=b;b=a;password=a;", "password=f(", "<password>", "<password ",
    "://a:", "--password ", "# password=", "/* password=", "password: str = ", "def password():\n ", "password=$", "name:x value:", "\\\"password\\\":\\\"", "'password=", "\t \t password", "password=a or ", "x=x+x;password=x;",
    "password=('a'\n", "::=password", "a.b.password.", "password = r'", "é'password'=",
])
def test_work_goes_with_the_length(bit):
    def seconds(n):
        text, best = (bit * (n // len(bit) + 1))[:n], 9e9
        for _ in range(3):
            at = time.perf_counter()
            secret_scan.literal_spans(text)
            best = min(best, time.perf_counter() - at)
        return best

    seconds(2_000)
    assert seconds(80_000) < 3 * seconds(40_000) + 0.05


def test_joined_values_of_many_steps_keep_all_literals():
    text = "k0 = 'q7Zp'\n" + "".join(f"k{i} = k{i - 1} + '{i % 10}aXw'\n" for i in range(1, 300)) + "password = k299\n"
    found = secret_scan.literal_spans(text)
    assert len(found) == 300 and all(text[a - 1] == text[b] == "'" for a, b in found)


def test_parts_come_before_what_is_made_of_them():
    found = lexed("a = 'x1' + 'y2'\nb = a + a + 'z'\npassword = b + later\nlater = 'w'")
    assert found.parts and all(p < n for n, parts in found.parts.items() for p in parts)
