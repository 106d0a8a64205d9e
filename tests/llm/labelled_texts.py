"""Texts written by hand, apart from the generator of the training tables. A span is written as [[kind|text]]."""

import re

PII = """
Please forward the minutes to [[name|Margaret Osei]] before Friday, she asked twice.
Dear Mr. [[name|Whitfield]], your parcel could not be delivered this morning.
The appointment with Dr. [[name|Lena Hoffmann]] was moved to the second week of May.
Write to [[email|karen dot miller at outlook dot com]] if the link has expired.
You can reach me under [[email|j.novak (at) posteo (dot) de]] on weekdays only.
contact: [[email|sales [at] brightwood [dot] org]] or come to the front desk
Our switchboard answers at [[phone|(415) 555-0132]] from nine to five.
Call [[phone|020 7946 0958]] and ask for the night porter.
Tel: [[phone|030-901820-41]] (the office is closed on public holidays)
phone [[phone|212-555-0187]] , ext. 4
Fax: [[phone|(0221) 470 2311]]
mobile [[phone|0171 5550 2240]] after six in the evening
name: [[name|Joaquín Herrera]]
Name: [[name|Priya Raman]]
Kind regards, [[name|Thomas Eriksen]]
Sincerely, [[name|Amina Diallo]]
The letter was signed [[name|Harriet Vance]] and dated the ninth.
Frau [[name|Schneider]] hat den Vertrag gestern unterschrieben.
Herr [[name|Jonas Keller]] ist heute nicht im Büro und kommt morgen wieder.
Madame [[name|Fournier]] vous attend dans la salle du fond.
La carta era para la señora [[name|Lucía Benítez]] y llegó tarde.
Monsieur [[name|Paul Girard]] a quitté la réunion avant la fin.
Prof. [[name|Ingrid Solberg]] gave the opening lecture in the old hall.
author: [[name|Colin Mbeki]]
Ask Mrs. [[name|Dalloway]] about the flowers, she will buy them herself.
email me: [[email|rosa (at) lavanderia (dot) es]] , merci
mail [[email|info [at] talbruecke [dot] ch]] for a copy of the map
My old number was [[phone|617-555-0143]] until last spring.
telephone [[phone|(303) 555-0119]]
The train leaves at 10:45 from platform 7 and arrives at 12:20.
The board met in March and approved the budget of 2,450,000 dollars.
Version 2.14.3 fixes the crash that users of 2.14.1 have seen.
Order 20391877 was shipped on 2021-11-04 with two items.
The name of the village comes from an old word for river.
Call the function twice and compare the two results with each other.
A credit card is not needed for the free plan of the service.
Look at the dot in the corner of the map and follow the path north.
Die Sitzung beginnt um neun Uhr und endet gegen Mittag.
Il ne faut pas oublier que la mer est froide au mois de mai.
She played the card game with her sister until the lights went out.
Chapter 12 covers pages 310 to 344 and the exercises on page 350.
Results were 41.7, 39.2 and 44.0 percent in the three groups.
The contact lens fell on the floor of the bus and was lost.
An old address book lay on the table next to the phone.
"""

SECRETS = """
curl -H "Authorization: Bearer [[secret|eyJhbGciOiJIUzI1NiJ9x0Kq2Vt7LmPz]]" https://api.service.example/v1/items
the wifi passphrase is [[secret|Tr0ub4dor&3x]] and please do not share it
export STRIPE_KEY=sk_nothing_here
git clone with [[secret|ghp_9aZkQ2LmX7RtYv0BcNw3PsDf8Hj1Gk5Ue4]] as user name
auth = "[[secret|q7W2mZ8xLr4TkVb1NcYp0HsJ]]"
x-api-key: [[secret|Zx81kQpL02mVbn77TrEwQa93]]
the old pwd was [[secret|gr4pe_Fruit!9]] before the reset
credential: [[secret|s3cr3tW0rd_77]]
private_key := [[secret|MIIBVgIBADANBgkqhkiG9w0BAQEFAASCAUAwggE8]]
client_secret = '[[secret|8f_Kd02mXq!zR]]'
passphrase: [[secret|blue42-Horse!7]]
authorization: basic [[secret|dXNlcm5hbWU6cGFzc3dvcmQxMjM0NTY=]]
signature [[secret|k9Lm3Np5Qr7St1Uv2Wx4Yz6Ab8Cd0Ef]] was sent along with the body
login user maria pwd [[secret|k1tty_Cat99]]
const token_value = getToken();
bearer [[secret|A1b2C3d4E5f6G7h8I9j0K1l2]] expires in an hour
my pin is kept at home and not written down anywhere
openai uses [[secret|sk-4tYh8LmQ2wEr6UiOp9AsDf1GhJk3Zx]] for the calls
set access_token => [[secret|pQ8rS2tU5vW9xY1zA4bC7dE0]]
pwd: [[secret|hunter2!Zz9]]
The key to the house is under the mat by the back door.
A secret garden lies behind the wall of the old church.
The token was worth two coins at the fair in those days.
Bearer of good news, the courier ran all night long.
Basic training takes six weeks and ends with a march.
See https://docs.example.org/guides/authentication/index.html?lang=en for more
commit messages should be short and say what the change does
export PATH=/usr/local/bin:/usr/bin:/home/maria/tools
set host = localhost and port = 8080 in the file
user = maria ; shell = bash ; home = here
The password must have eight letters or more and no spaces.
Passphrase hints are shown after the third failed attempt.
const total = items.map(price).reduce(add, 0);
internationalization and counterrevolutionaries are long words
Key points are listed in the table on the following page.
The signature of the painter is hidden in the lower corner.
uuid columns are sorted as text in the report of 2023-05-17T08:30:00
"""


def read(block: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of each line."""
    out = []
    for line in filter(None, block.splitlines()):
        text, spans = "", []
        for i, part in enumerate(re.split(r"\[\[(\w+\|(?:[^\]]|\](?!\]))*)\]\]", line)):
            if i % 2:
                kind, inner = part.split("|", 1)
                spans.append((len(text), len(text) + len(inner), kind))
                part = inner
            text += part
        out.append((text, spans))
    return out
