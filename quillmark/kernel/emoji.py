"""Emoji shortcodes: a small table; larger ones are given by the caller."""

from __future__ import annotations

# Common shortcodes of the public gemoji set.
SHORTCODES = {
    "+1": "👍", "-1": "👎", "100": "💯", "art": "🎨", "beers": "🍻", "bell": "🔔", "blush": "😊", "book": "📖", "boom": "💥",
    "bug": "🐛", "bulb": "💡", "cake": "🍰", "camera": "📷", "car": "🚗", "cat": "🐱", "clap": "👏", "cloud": "☁️", "coffee": "☕",
    "construction": "🚧", "cry": "😢", "dog": "🐶", "earth_africa": "🌍", "email": "📧", "eyes": "👀", "fire": "🔥", "fish": "🐟",
    "gift": "🎁", "ghost": "👻", "grin": "😁", "grinning": "😀", "hammer": "🔨", "heart": "❤️", "heavy_check_mark": "✔️", "house": "🏠",
    "hourglass": "⌛", "hugs": "🤗", "joy": "😂", "key": "🔑", "kiss": "💋", "laughing": "😆", "leaves": "🍃", "lemon": "🍋",
    "link": "🔗", "lock": "🔒", "mag": "🔍", "memo": "📝", "moon": "🌔", "mushroom": "🍄", "musical_note": "🎵", "no_entry": "⛔",
    "ok": "🆗", "ok_hand": "👌", "package": "📦", "penguin": "🐧", "pencil2": "✏️", "pizza": "🍕", "point_right": "👉", "poop": "💩",
    "question": "❓", "rabbit": "🐰", "rainbow": "🌈", "recycle": "♻️", "rocket": "🚀", "rose": "🌹", "scream": "😱", "ship": "🚢",
    "skull": "💀", "sleeping": "😴", "smile": "😄", "smiley": "😃", "smirk": "😏", "snowflake": "❄️", "sob": "😭", "sparkles": "✨",
    "star": "⭐", "star2": "🌟", "sunglasses": "😎", "sunny": "☀️", "tada": "🎉", "thinking": "🤔", "thumbsdown": "👎", "thumbsup": "👍",
    "trophy": "🏆", "turtle": "🐢", "umbrella": "☔", "unlock": "🔓", "warning": "⚠️", "wave": "👋", "white_check_mark": "✅", "wink": "😉",
    "wrench": "🔧", "x": "❌", "yum": "😋", "zap": "⚡", "zzz": "💤",
}
