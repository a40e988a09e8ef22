"""Problem 5: the story of a page without its furniture, by a decision tree over flat text blocks.

Method: flat text blocks with their word count and link density and those of their neighbours, classified by a decision
tree that is trained on a small labelled table (LABELLED below, some 200 lines written for this purpose).

Defined results: null and empty texts have no blocks; blank lines are counted in line numbers and never classified;
a page of a single line is classified by that line alone. Texts are used whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from wirelark.llm import tree
from wirelark.llm.blocks import Blocks, blocks

#: Labelled pages: "+" belongs to the story, "-" is furniture; an empty line ends a page.
LABELLED = """
- Home | World | Politics | Business | Sport
- Search this site
- We use cookies to understand how the site is read. Accept all or manage choices.
- Home / World / Storm closes the coast road for a second day
- By Anna Keller, The Example Post
+ The coast road stayed closed on Monday after a storm pushed stones and sand over both lanes near the old light tower.
+ Crews worked through the night, the county said, and hoped to open one lane before the weekend.
- Advertisement
+ "We have not seen waves of this height since the nineties," the harbour master said.
+ A slow recovery
+ Shops along the road said that they had lost most of a week, and two of them will stay closed until May.
+ The county council will decide on Thursday whether to pay for a wall.
- Share this story: Mail Print Link
- In other news
- Farmers fear a dry spring after the mildest winter on record
- Museum buys a lost painting
- Train drivers and their union agree on a new contract before the holidays
- 1. School kitchens run short of cooks
- The Example Post is not responsible for the content of linked sites.
- Copyright 2022 The Example Post. All rights reserved.
- 23 comments
- Tom Hale, 3 hours ago: They promised us this wall ten years ago and nothing came of it. Reply Report

- Menu
- Science
- Culture
- Opinion
- Log in to The Example Post
- Your privacy choices: allow, decline, or set preferences.
- Words: Maria Lopes
+ Researchers at the university have found a way to store heat in ordinary salt for weeks.
+ - the salt costs a few cents a kilo
+ - it can be charged with waste heat
+ * tested in three houses
+ * salt (heated)
+ - price: 40 euros a month, paid by the state
+ From salt to steam
+ The first plant of this kind should run by 2027, and the team is looking for a town that wants to host it.
- Enjoying this? Support The Example Post from 3 a month
+ Questions that stay open
+ Nobody knows yet how often the salt can be used before it clumps, and the tests that would show it take a year.
- Have you seen something like this? Tell the Example Post science desk.
- Tell a friend  Print  Save for later
- Read next: Why the old reactor is still not gone
- Webinar: heat for towns, 12 June. Register now
- Back to top

- Skip to main content
- World · Health · Opinion · Archive
- We and our 90 partners store data on your device.
- Filed under: health, hospitals, budget
- Maria Lopes | The Example Post
+ LONDON - The minister told parliament that the waiting list had grown for a third year.
+ Correction: Late on Friday, the office said that the figure was for England alone.
+ What the figures hide
+ It took most patients four months to see a doctor, and one in ten waited for more than a year, the report noted.
- More from The Example Post
- • Two hospitals share one kitchen
- • The nurse who would not retire: a portrait from the night shift at Saint Anne
+ Members of the union were told to keep a record of every extra hour before the talks begin again.
- Figures in this story were rounded by the agency.
- Share on Blip Share on Chirp Copy link
- © 2021 The Example Post - Terms - Privacy - Imprint
- Up next: The long road to a new clinic
- Poll: have you waited for more than a month? Yes 31% No Vote

- Events, Tools, Archive, Local, Opinion
- Jump to the sport section
- By staying on example.org you agree to our use of cookies.
- Jan Novak, staff writer
+ The match was stopped after ten minutes because of fog. It was played again on Wednesday, before a much smaller crowd, and ended without a goal.
- Get the Example Post sport newsletter
+ Two teams, one pitch
+ The head of the league said that the rule would be changed, but clubs in the north disagreed. (continues)
+ What fans were told
+ The club wrote that tickets would be valid for the second date and that anyone who could not come Continue reading
+ Parking around the ground was free on both days, which the town had not planned for.
- The second half began an hour late and many had left by then. [Continue]
- The coach called it the strangest evening of his life. ... more
- Fans from abroad slept in the station hall. Read more
- The club has offered vouchers to those who stayed. Full story >
- Reporting pooled under the shared desk agreement.
- This item first ran in the regional edition.
- Part of the Example Post series on winter sport.
- Corrected after publication to fix the name of the referee.
- Like what you read? Pass it on. 41 shares
- The material on example.org may not be republished without the consent of The Example Post.
- The Example Post follows the press code. Send corrections to desk@example.org.
- Contact The Example Post: desk@example.org

- Policy   Local   Schools   Health
- Accessibility help
- This page remembers your visit so that readers can see fitting adverts. OK / Settings
- Written by Jon Asker for The Example Post
- Northgate 14°C, pollen index 3.5
+ Teachers had asked for smaller classes since 2015, yet the new law keeps the limit at thirty.
- - Sponsored -
+ A law with few friends
+ The vote was close, and four members of the ruling party stayed away.
- You may also like
- Pupils plan a march on the capital
- How a village school found eleven new pupils and kept its only teacher
- 3. Old books, new readers: the library bus returns
- Why so many headteachers leave early
- Parents win a fight over lunch breaks in court
- Exam results arrive a week late in five counties this summer
- Chalk is back
- Previous story: Universities raise their fees again
- Event: open day at the science park, 4 July. Register now
- Free guide: choosing a school, 24 May. Register now

- The Example Post home page
- Cookies help this site work. Got it!
- Tags: fire, forest, summer
- Posted in: weather, fire, north
+ Home owners near the forest were asked to leave on Sunday evening, and most had gone by midnight.
+ None of the forty firefighters who were in the valley when the wind turned was hurt.
- Story continues below this advert
+ The fire was seen first by a pilot who had flown over the ridge on his way home and who then called
- Related coverage
- • Summer heat breaks a record of eighty years in three cities of the south
- 2. Wells run dry
+ Wind and dry grass
+ Whoever lit the fire also left a can and a lighter at the edge of the field, an officer said.
- Download our app
- Sign up: The Example Post in your inbox each morning
- Article continues after promotion
+ Advertised prices of cabins in the valley fell by half within a week, an agent told the paper.
+ A visitor noted that comments on the map of the fire had been removed before the inquiry started.
- Most read
- Bears move closer to the villages
- Rain at last
- Read more about: fire, forest, insurance
- Advertise with us

- Reports / Health / Tools / Video
- By Jon Asker
+ The bank said that the error was found by a customer who had counted twice.
+ Event logs show that the first wrong transfer left on 1 July and the last one on 9 July.
+ Contact details of nine customers were sent to the wrong branch, and the home addresses of two more followed.
+ A policy
+ - tell customers about the error
+ - check each account for a second entry
+ * refunds (paid)
+ * old fees (dropped)
+ * cards, phones and letters
+ Money for the wrong people
+ More customers were told to share the letter with their families, and the home office kept a copy.
- Next: The small town with four banks
- 2 comments
- Anna Berg, 2 days ago: It happened to us too, and nobody answered the phone. Reply Report

- In other news
- Ferry company apologises for a week of cancelled sailings
- 4. Harbour cranes to be sold
+ - tell passengers about the new times
+ - stop selling tickets for the late boat
+ * 40 sailings, later restored
+ The island shop explained that bread had been flown in twice, although the pilots charged nothing.
- You may also like
- Why the lighthouse stays dark until spring
- • Small islands pay twice for the same boat under a rule from 1954
+ - replace the old ramp and keep the new one
+ - ramp: closed on 7 May, 300 cars
+ Deliveries stopped for nine days because the ramp could not be lowered.
- Most read
- The captain who knew every rock: farewell to a neighbour
- Islanders vote on a bridge
+ The company is owned by two brothers and has run the line since their father died.
- More from The Example Post
- Ferry prices climb again
- 3. A harbour without ships waits for a plan from the capital
+ Who pays for the wait
+ The ministry said that the old contract had ended in March and had been kept going by mistake.
- In other news
- • Boats for rent
- Two towns want the same festival and neither will move its date
+ What islanders were told
+ Insurers have paid forty claims over spoiled goods, and a court will hear the rest in June.
- You may also like
- Council meets on Monday to talk about the new harbour fees
- A market for old nets
+ Deliveries of post took nine days, the manager said, because the sorting office could not be opened in time.
- Most read
- How the smallest island in the north came to own a railway carriage
- 2. Shops stay open on Sundays this summer in most coastal towns
+ Whoever opens the ramp must also sign a book, an inspector told the council on Friday in a closed session.
- Related coverage
- Seals return to the bay
+ From ramp to road in an hour
+ Staff were told on Tuesday to keep the paper tickets until the new machine had been checked twice.

+ The hospital said on Monday that two lifts had been replaced and that nobody was hurt.
- Related coverage
- Old lifts make a new home for bats
- • Two hospitals share one roster after the winter storm
- Advertisement
+ A second hospital, warned in May, found the same fault in four lifts and told its staff to take the stairs.
- You may also like
- 1. Small towns pay more for care than cities do, a study finds
- 2. Old maps return to the library
- Library staff learn to mend books
- Copyright 2023 The Example Post. All rights reserved.

- Breaking
- Latest headlines
- Ferry prices climb again
- Council meets on Monday
- Teachers plan a march
- Advertisement
+ The ferry company apologised on Friday for a week of cancelled sailings and promised refunds to every passenger.
+ A spokesman said the fault had been found in a pump that nobody had looked at since March.
- Photo: harbour at dawn
- All rights reserved

+ The town will plant four hundred trees along the river this autumn, most of them oaks and alders.

+ Two men were arrested on Friday after a chase through the old town. They had taken a bus and driven it through a market.

+ A long letter from the mayor was read in all schools on Monday. It asks pupils to walk if they can, and it asks their parents to leave the car at home for a week in May, when the main street will be closed.

+ Rain is expected.

- Copyright 2020 The Example Post. All rights reserved.

- Subscribe to our newsletter

+ The orchestra will play in the station hall until its own roof is mended.
+ Tickets cost the same, and trains will run late on those evenings.

- By staying on example.org you agree to our use of cookies.
+ The orchestra will play in the station hall until its own roof is mended. Tickets cost the same, and trains will run late on those evenings.
- The Example Post follows the press code. Send corrections to desk@example.org.

+ The observatory found a comet that will pass in March and can be seen without a glass.
+ It was named after the cleaner who had left the dome open.
+ Its tail is as long as the moon is wide, a student measured.
+ The next one of this size is due in ninety years, and it will come from the south, where there are few telescopes.
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    pages, marks = [], []
    for page in LABELLED.strip("\n").split("\n\n"):
        rows = page.split("\n")
        pages.append("\n".join(r[2:] for r in rows))
        marks += [r[0] == "-" for r in rows]
    b = blocks(pa.array(pages))
    return b.x, np.array(marks, dtype=float)


@cache
def model() -> tree.Node:
    return tree.fit(*labelled())


def furniture(texts: pa.Array) -> tuple[Blocks, np.ndarray]:
    """The blocks of pages, and for each line whether it is furniture (blank lines are not)."""
    b = blocks(texts)
    out = np.zeros(len(b.doc), dtype=bool)
    out[b.full] = tree.score(model(), b.x) >= 0.5
    return b, out


def join_story(parts: tuple[Blocks, np.ndarray], n: int) -> list[str]:
    """The story of each of n pages, one block a line, from what furniture() gave."""
    b, bad = parts
    keep = np.flatnonzero(b.full & ~bad)
    lines, doc = b.line.take(pa.array(keep)).to_pylist(), b.doc[keep]
    ends = np.searchsorted(doc, np.arange(n + 1))
    return ["\n".join(lines[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def main_texts(texts: pa.Array) -> list[str]:
    """The story of each page, one block a line."""
    return join_story(furniture(texts), len(texts))
