"""Values in spellings written by hand, not by the generator that the tagger learns from. `{}` in a sentence is where they stand."""

SENTENCES = ("Please write to {} before noon.", "Kontakt: {}", "the old one was {} I think", "({})", "see {}, or ask at the desk")

EMAIL = """
anna.berg (at) posteo (dot) de
anna.berg [at] posteo [dot] de
anna.berg {at} posteo {dot} de
anna.berg <at> posteo <dot> de
anna.berg AT posteo DOT de
anna.berg at posteo dot de
anna berg at posteo dot de
sarah dot connor at skynet dot co dot uk
sarah.connor(at)skynet.co.uk
sarah.connor[at]skynet.co.uk
sarah.connor (at) skynet.co.uk
sarah.connor @ skynet.co.uk
sarah.connor @skynet.co.uk
sarah.connor@ skynet.co.uk
info -at- firma -dot- at
info_at_firma_dot_at
info(a)firma.at
info [@] firma.at
info(@)firma.at
info [AT] firma [PUNKT] at
jean-luc.picard (arobase) starfleet.fr
support at example (dot) org
support@example[.]org
support@example(.)org
support [ at ] example [ dot ] org
j.doe+news (at) mail.example.com
j_doe at mail dot example dot com
webmaster(at)uni-heidelberg.de
kim.lee 'at' naver 'dot' com
kim.lee "at" naver "dot" com
""".strip().split("\n")

IP = """
10 . 0 . 0 . 1
192 . 168 . 17 . 4
192[.]168[.]17[.]4
192(.)168(.)17(.)4
192.168.17[.]4
8[.]8[.]8[.]8
172 dot 16 dot 254 dot 3
172 (dot) 16 (dot) 254 (dot) 3
172[dot]16[dot]254[dot]3
203-0-113-77
203,0,113,77
203 0 113 77
198. 51. 100. 23
198 .51 .100 .23
198{.}51{.}100{.}23
10·20·30·40
""".strip().split("\n")

CARD = """
4111.1111.1111.1111
4111/1111/1111/1111
4111_1111_1111_1111
4111  1111  1111  1111
4111 - 1111 - 1111 - 1111
4111–1111–1111–1111
5555.5555.5555.4444
5555 5555  5555 4444
5105,1051,0510,5100
5105:1051:0510:5100
3782.822463.10005
3782/822463/10005
3714 – 496353 – 98431
6011.1111.1111.1117
6011_1111_1111_1117
3530.1113.3330.0000
4012.8888.8888.1881
4012 / 8888 / 8888 / 1881
4012·8888·8888·1881
30000.0000.0000.4
""".strip().split("\n")

PHONE = """
(020) 7946 0958
020 7946 0958
020-7946-0958
0207 946 0958
0151 23456789
0151/23456789
0151-234 567 89
030/901820
030 / 90 18 20 0
(030) 90 18 20 33
089 / 636-48018
0043 1 534 60 0
0049 30 901820
0033 1 42 68 53 00
01 42 68 53 00
01.42.68.53.00
01-42-68-53-00
06 12 34 56 78
06.12.34.56.78
91 411 25 00 99
91-411-25-00-99
600 123 456
600.123.456
(212) 555-0147
212-555-0147
212.555.0147
212 555 0147
1-212-555-0147
1 (212) 555-0147
1.212.555.0147
555-867-5309
(555) 867.5309
tel 0800 1234567
0800-123-4567
0 800 123 45 67
044 668 18 00
044/668 18 00
0664 1234567
""".strip().split("\n")

VALUES = [(kind, v.removeprefix("tel ")) for kind, values in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for v in values]
#: Numbers that are none of these.
OTHERS = """
12 34 56 78 90 12 34
ISBN 978-3-16-148410-0
550e8400-e29b-41d4-a716-446655440000
2024-01-05 10:20:30
05.01.2024
version 10.0.19045
§ 433 Abs. 2 BGB
1,234,567.89
1.234.567,89 Euro
3.14159265358979
from 1998 to 2004
pages 112-118
the score was 3-2, 4-1, 5-0
room 12 at level 3
look at that dot over there
meet me at noon dot
A4 210 x 297 mm
12:30-14:45
52.5200 N, 13.4050 E
order no. 2024/000123
""".strip().split("\n")
