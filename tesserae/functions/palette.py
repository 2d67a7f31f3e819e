"""Colors of ordered categories and of positive class identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: color of missing and of unknown categories.
NEUTRAL_COLOR = "#DCE8F2CC"

# Fixed value: the one color of a selection that is empty or has too many values to tell apart.
SOLID_POINT_COLOR = "#00FFFF"

# The widely used 102 maximally distinct colors (black left out), in their usual order.
DISTINCT_COLORS = (
    "#FFFF00", "#1CE6FF", "#FF34FF", "#FF4A46", "#008941", "#006FA6", "#A30059", "#FFDBE5", "#7A4900",
    "#0000A6", "#63FFAC", "#B79762", "#004D43", "#8FB0FF", "#997D87", "#5A0007", "#809693", "#6A3A4C",
    "#1B4400", "#4FC601", "#3B5DFF", "#4A3B53", "#FF2F80", "#61615A", "#BA0900", "#6B7900", "#00C2A0",
    "#FFAA92", "#FF90C9", "#B903AA", "#D16100", "#DDEFFF", "#000035", "#7B4F4B", "#A1C299", "#300018",
    "#0AA6D8", "#013349", "#00846F", "#372101", "#FFB500", "#C2FFED", "#A079BF", "#CC0744", "#C0B9B2",
    "#C2FF99", "#001E09", "#00489C", "#6F0062", "#0CBD66", "#EEC3FF", "#456D75", "#B77B68", "#7A87A1",
    "#788D66", "#885578", "#FAD09F", "#FF8A9A", "#D157A0", "#BEC459", "#456648", "#0086ED", "#886F4C",
    "#34362D", "#B4A8BD", "#00A6AA", "#452C2C", "#636375", "#A3C8C9", "#FF913F", "#938A81", "#575329",
    "#00FECF", "#B05B6F", "#8CD0FF", "#3B9700", "#04F757", "#C8A1A1", "#1E6E00", "#7900D7", "#A77500",
    "#6367A9", "#A05837", "#6B002C", "#772600", "#D790FF", "#9B9700", "#549E79", "#FFF69F", "#201625",
    "#72418F", "#BC23FF", "#99ADC0", "#3A2465", "#922329", "#5B4534", "#FDE8DC", "#404E55", "#0089A3",
    "#CB7E98", "#A4E804", "#324E72",
)

# The CSS color names with their colors, the ten tableau colors, and the one-letter colors.
NAMED_COLORS = dict(entry.split("=") for entry in """
aliceblue=f0f8ff antiquewhite=faebd7 aqua=00ffff aquamarine=7fffd4 azure=f0ffff beige=f5f5dc bisque=ffe4c4 black=000000
blanchedalmond=ffebcd blue=0000ff blueviolet=8a2be2 brown=a52a2a burlywood=deb887 cadetblue=5f9ea0 chartreuse=7fff00
chocolate=d2691e coral=ff7f50 cornflowerblue=6495ed cornsilk=fff8dc crimson=dc143c cyan=00ffff darkblue=00008b darkcyan=008b8b
darkgoldenrod=b8860b darkgray=a9a9a9 darkgreen=006400 darkgrey=a9a9a9 darkkhaki=bdb76b darkmagenta=8b008b darkolivegreen=556b2f
darkorange=ff8c00 darkorchid=9932cc darkred=8b0000 darksalmon=e9967a darkseagreen=8fbc8f darkslateblue=483d8b
darkslategray=2f4f4f darkslategrey=2f4f4f darkturquoise=00ced1 darkviolet=9400d3 deeppink=ff1493 deepskyblue=00bfff
dimgray=696969 dimgrey=696969 dodgerblue=1e90ff firebrick=b22222 floralwhite=fffaf0 forestgreen=228b22 fuchsia=ff00ff
gainsboro=dcdcdc ghostwhite=f8f8ff gold=ffd700 goldenrod=daa520 gray=808080 green=008000 greenyellow=adff2f grey=808080
honeydew=f0fff0 hotpink=ff69b4 indianred=cd5c5c indigo=4b0082 ivory=fffff0 khaki=f0e68c lavender=e6e6fa lavenderblush=fff0f5
lawngreen=7cfc00 lemonchiffon=fffacd lightblue=add8e6 lightcoral=f08080 lightcyan=e0ffff lightgoldenrodyellow=fafad2
lightgray=d3d3d3 lightgreen=90ee90 lightgrey=d3d3d3 lightpink=ffb6c1 lightsalmon=ffa07a lightseagreen=20b2aa
lightskyblue=87cefa lightslategray=778899 lightslategrey=778899 lightsteelblue=b0c4de lightyellow=ffffe0 lime=00ff00
limegreen=32cd32 linen=faf0e6 magenta=ff00ff maroon=800000 mediumaquamarine=66cdaa mediumblue=0000cd mediumorchid=ba55d3
mediumpurple=9370db mediumseagreen=3cb371 mediumslateblue=7b68ee mediumspringgreen=00fa9a mediumturquoise=48d1cc
mediumvioletred=c71585 midnightblue=191970 mintcream=f5fffa mistyrose=ffe4e1 moccasin=ffe4b5 navajowhite=ffdead navy=000080
oldlace=fdf5e6 olive=808000 olivedrab=6b8e23 orange=ffa500 orangered=ff4500 orchid=da70d6 palegoldenrod=eee8aa
palegreen=98fb98 paleturquoise=afeeee palevioletred=db7093 papayawhip=ffefd5 peachpuff=ffdab9 peru=cd853f pink=ffc0cb
plum=dda0dd powderblue=b0e0e6 purple=800080 rebeccapurple=663399 red=ff0000 rosybrown=bc8f8f royalblue=4169e1
saddlebrown=8b4513 salmon=fa8072 sandybrown=f4a460 seagreen=2e8b57 seashell=fff5ee sienna=a0522d silver=c0c0c0
skyblue=87ceeb slateblue=6a5acd slategray=708090 slategrey=708090 snow=fffafa springgreen=00ff7f steelblue=4682b4 tan=d2b48c
teal=008080 thistle=d8bfd8 tomato=ff6347 turquoise=40e0d0 violet=ee82ee wheat=f5deb3 white=ffffff whitesmoke=f5f5f5
yellow=ffff00 yellowgreen=9acd32 none=00000000
tab:blue=1f77b4 tab:orange=ff7f0e tab:green=2ca02c tab:red=d62728 tab:purple=9467bd tab:brown=8c564b tab:pink=e377c2
tab:gray=7f7f7f tab:grey=7f7f7f tab:olive=bcbd22 tab:cyan=17becf
b=0000ff g=008000 r=ff0000 c=00bfbf m=bf00bf y=bfbf00 k=000000 w=ffffff
""".split())
CYCLE = "1f77b4 ff7f0e 2ca02c d62728 9467bd 8c564b e377c2 7f7f7f bcbd22 17becf".split()


def default_color(position: Column) -> Column:
    """Cyclic color of a one-based position or class identifier; null below one."""
    index = F.pmod(position.cast("long") - 1, F.lit(len(DISTINCT_COLORS))).cast("int")
    return F.when(position > 0, F.element_at(F.lit(list(DISTINCT_COLORS)), index + 1))


def color_value(value: Column) -> Column:
    """A color as `#` and eight lower-case hexadecimal digits; null if it is none.

    Known are hexadecimal colors of 3, 4, 6 or 8 digits, names in any case, one-letter names in lower case, `C` with a number
    for the ten tableau colors in turn, and numbers from 0 to 1 for grays.
    """
    text = F.lower(value)
    digits = F.regexp_extract(text, "^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$", 1)
    digits = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    table = F.create_map(*[F.lit(x) for pair in NAMED_COLORS.items() for x in pair])
    turn = F.regexp_extract(value, "^C([0-9]*)([0-9])$", 2)
    number = F.when(value.rlike(r"^[0-9.]+([eE][+-]?[0-9]+)?$"), value.try_cast("double"))
    level = F.lower(F.lpad(F.hex(F.bround(number * 255).cast("long")), 2, "0"))
    found = (
        F.when(F.length(digits) > 0, digits)
        .when(F.length(turn) > 0, F.element_at(F.lit(CYCLE), turn.try_cast("int") + 1))
        .when(number.between(0, 1), F.concat(level, level, level))
        .otherwise(F.try_element_at(table, F.when(F.length(value) == 1, value).otherwise(text)))
    )
    return F.concat(F.lit("#"), F.rpad(found, 8, "f"))


def is_color(value: Column) -> Column:
    return color_value(value).isNotNull()
