"""Small invented tables for cases that the driver's tables don't have."""

from __future__ import annotations

DAY_CYCLE = ["Saturday evening", "Palm Sunday", "Monday", "Tuesday morning", "Tuesday afternoon", "Wednesday", "Olivet", "Friday early morning", "Summary", "Sunday", ""]

MARKUP = [
    (-1, "One account <doc , sep> another <DOC-sepx> third <v-sep> fourth"),
    (-2, "a <citation id=1>b</citation>  c <doc-p> d <nowiki/> e"),
    (-3, "plain < 3 and > 2"),
]
DIRTY = [
    (-1, "He said.. “U S A” <b>ok</b>,, a end.next"),
    (-2, "‘so’ it is!now?yes  ,,, done..."),
    (-3, "x y z"),
]
TURNS = [
    (-1, 0, "user", "They did not go."),
    (-1, 1, "user", "They don't know"),
    (-1, 2, "user", "NEVER again, nor now"),
    (-1, 3, "user", "Nothing notable"),
]
VERSES = [
    ("matthew", 0, 1, 1, "On the third day, about the sixth hour, after three days, the Feast of three days began."),
    ("matthew", 1, 1, 2, "Then he began to teach them. They did not believe what he said, until the evening."),
    ("matthew", 2, 1, 3, "Prior to that they were there. As soon as he spoke, they heard it."),
    ("matthew", 3, 2, 1, "He told them that it was so. And they went up the hill before the next day."),
    ("matthew", 4, 2, 2, "They went up again, later."),
    ("mark", 0, 1, 1, "In the morning they want to go. They go to Bethel."),
    ("mark", 1, 1, 2, "They see no one. Nobody is there."),
    ("mark", 2, 2, 1, "Meanwhile he called them to the hill, when it was noon."),
    ("luke", 0, 1, 1, "The second hour came, and the Sabbath was near."),
    ("luke", 1, 1, 2, "They decide to stay. They stay two years."),
]
TIMES = ["three days", "forty days", "about the sixth hour", "the second hour", "the third day", "the next day", "the following day", "Sabbath", "Passover", "five days", "the first day", " A WEEK ", "the eleventh hour", "three years"]
TIMETABLE_SCHEMA = "chronology_index int, description string, day string, matthew string, mark string, luke string"
TIMETABLE = [
    (0, "Arrival", "Saturday", "1:1", "1:1", None),
    (1, "Teaching", "Monday", "1:2-3", " 1:2 ", "1:1a"),
    (2, "Hill", "Monday", "1:3-2:2", "2:1b", ""),
    (3, "Arrival", "Tuesday", "2:1", None, "1:1-2"),
    (4, "Nothing", "Tuesday", None, "Acts 1:1", None),
    (5, "Alone", None, None, None, "1:2b"),
    (6, "Backwards", "Olivet", "2:1-1:1", "1:9-7", None),
]
GROUP_LINKS_SCHEMA = "group_id string, event_id string, related_to_event string, rel_type string, doc_id string, ord int"
GROUP_LINKS = [
    ("g0", "e1", "e2", "BEFORE", "d1", 0),
    ("g0", "e1", "e2", "AFTER", "d2", 1),
    ("g1", "e1", "e2", "BEFORE", "d1", 2),
    ("g1", "e1", "e2", "SIMULTANEOUS", "d2", 3),
    ("g2", "e1", "e2", "SIMULTANEOUS", "d1", 4),
    ("g2", "e1", "e2", "BEFORE", "d2", 5),
    ("g3", "e1", "e2", "BEFORE", "d1", 6),
    ("g3", "e1", "e2", "AFTER", "d2", 7),
    ("g3", "e1", "e2", "BEFORE", "d2", 8),
    ("g4", "e3", "e4", "BEGINS", "d2", 9),
    ("g4", "e3", "e4", "ENDS", "d3", 10),
    ("g4", "e3", "e5", "ENDS", "d3", 11),
]
REFERENCES = ["21:1-7", "15:18-16:4", "21:19a", "21:19b-22", "3:5 - 7", "22:9-7", "(21:37-38)", "[17:37]", "Acts 1:18-19", "1 Co. 11:25", "3:1-2-3", "", "15:1-18:4", "15:1-19:4", "16:4-15:2", " 7:8 ", "2:3a-5b", "1:2a-2:3b"]
ODD_REFERENCES = ["3:16 and more", "4:5-6-7:8", "12:99:1", "x 3:16"]
NODES = [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5)]
EDGES = [("a", "c"), ("b", "c"), ("c", "d"), ("a", "d"), ("f", "b")]
