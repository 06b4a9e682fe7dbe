"""A set of pages with the text that belongs to them, made from a rule: some say what their parts are, some don't."""

import random

WORDS = "river stone garden winter letter morning window bridge summer travel quiet distant yellow market story corner island evening harbour valley".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def links(rng, n, tag="li"):
    return "".join(f"<{tag}><a href='/{k}'>{rng.choice(WORDS).capitalize()}</a></{tag}>" for k in range(n))


def prose(rng):
    """(markup, text) of paragraphs: long ones, with short, linked and listed ones between them."""
    parts = [sentence(rng, 25)]
    for _ in range(rng.randrange(3, 7)):
        parts.append(rng.choice([lambda: sentence(rng, rng.randrange(15, 40)), lambda: "Never", lambda: "No", lambda: f"<a href='/x'>{sentence(rng, 3)}</a>", lambda: f"{rng.choice(WORDS)}: {rng.choice(WORDS)}"])())
        parts.append(sentence(rng, rng.randrange(15, 30)))
    text = " ".join(p.split(">")[1].split("<")[0] if p.startswith("<") else p for p in parts)
    return "".join(f"<p>{p}</p>" for p in parts), text


def pages():
    """(kind, html, text)."""
    out = []
    for seed in range(20):
        rng = random.Random(seed)
        body, text = prose(rng)
        menu, more = links(rng, 6), links(rng, 5)
        say = sentence(rng, 7)  # a sentence among links
        out += [
            ("plain", f"<body><ul>{menu}</ul><div>{body}</div><div><ul>{more}</ul></div></body>", text),
            ("sentence among links", f"<body><div>{links(rng, 3, 'p')}<p>{say}</p>{links(rng, 3, 'p')}</div><section><h1>{say}</h1>{body}</section></body>", f"{say} {text}"),
            ("article", f"<body><nav><ul>{menu}</ul></nav><article class='post social'><header><h1>{say}</h1></header>{body}<ul>{more}</ul><div class='ad'>{sentence(rng, 9)}</div></article><footer>{sentence(rng, 12)}</footer></body>", " ".join([say, text, *(x.split("<")[0] for x in more.split("'>")[1:])])),
            ("comments", f"<body><main>{body}</main><section id='comments'><article class='comment'><p>{sentence(rng, 20)}</p></article></section><aside><p>{sentence(rng, 20)}</p></aside></body>", text),
            ("names", f"<body class='sidebar-left'><div id='menu'><ul>{menu}</ul></div><div class='cookie-notice'>{sentence(rng, 15)}</div><div class='side'>{body}</div><div class='newsletter'><form><input>{say}</form><p>{say}</p></div></body>", text),
            ("mixed names", f"<body><div class='post-comment-guide'>{body}</div><div class='footerLinks'>{sentence(rng, 5)}<a href='/'>{say}</a></div></body>", text),
        ]
    return out
