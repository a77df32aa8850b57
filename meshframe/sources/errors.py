"""Error codes and their names: a lookup with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The published codes and their names, general codes first.
CODES = """
0x00000000 DD_OK
0x80004001 DDERR_UNSUPPORTED
0x80004005 DDERR_GENERIC
0x8007000E DDERR_OUTOFMEMORY
0x80070057 DDERR_INVALIDPARAMS
0x88760005 DDERR_ALREADYINITIALIZED
0x8876000A DDERR_CANNOTATTACHSURFACE
0x88760014 DDERR_CANNOTDETACHSURFACE
0x88760028 DDERR_CURRENTLYNOTAVAIL
0x88760037 DDERR_EXCEPTION
0x8876005A DDERR_HEIGHTALIGN
0x8876005F DDERR_INCOMPATIBLEPRIMARY
0x88760064 DDERR_INVALIDCAPS
0x8876006E DDERR_INVALIDCLIPLIST
0x88760078 DDERR_INVALIDMODE
0x88760082 DDERR_INVALIDOBJECT
0x88760091 DDERR_INVALIDPIXELFORMAT
0x88760096 DDERR_INVALIDRECT
0x887600A0 DDERR_LOCKEDSURFACES
0x887600AA DDERR_NO3D
0x887600B4 DDERR_NOALPHAHW
0x887600CD DDERR_NOCLIPLIST
0x887600D2 DDERR_NOCOLORCONVHW
0x887600D4 DDERR_NOCOOPERATIVELEVELSET
0x887600D7 DDERR_NOCOLORKEY
0x887600DC DDERR_NOCOLORKEYHW
0x887600DE DDERR_NODIRECTDRAWSUPPORT
0x887600E1 DDERR_NOEXCLUSIVEMODE
0x887600E6 DDERR_NOFLIPHW
0x887600F0 DDERR_NOGDI
0x887600FA DDERR_NOMIRRORHW
0x887600FF DDERR_NOTFOUND
0x88760104 DDERR_NOOVERLAYHW
0x88760118 DDERR_NORASTEROPHW
0x88760122 DDERR_NOROTATIONHW
0x88760136 DDERR_NOSTRETCHHW
0x8876013C DDERR_NOT4BITCOLOR
0x8876013D DDERR_NOT4BITCOLORINDEX
0x88760140 DDERR_NOT8BITCOLOR
0x8876014A DDERR_NOTEXTUREHW
0x8876014F DDERR_NOVSYNCHW
0x88760154 DDERR_NOZBUFFERHW
0x8876015E DDERR_NOZOVERLAYHW
0x88760168 DDERR_OUTOFCAPS
0x8876017C DDERR_OUTOFVIDEOMEMORY
0x8876017E DDERR_OVERLAYCANTCLIP
0x88760180 DDERR_OVERLAYCOLORKEYONLYONEACTIVE
0x88760183 DDERR_PALETTEBUSY
0x88760190 DDERR_COLORKEYNOTSET
0x8876019A DDERR_SURFACEALREADYATTACHED
0x887601A4 DDERR_SURFACEALREADYDEPENDENT
0x887601AE DDERR_SURFACEBUSY
0x887601B3 DDERR_CANTLOCKSURFACE
0x887601B8 DDERR_SURFACEISOBSCURED
0x887601C2 DDERR_SURFACELOST
0x887601CC DDERR_SURFACENOTATTACHED
0x887601D6 DDERR_TOOBIGHEIGHT
0x887601E0 DDERR_TOOBIGSIZE
0x887601EA DDERR_TOOBIGWIDTH
0x887601FE DDERR_UNSUPPORTEDFORMAT
0x88760208 DDERR_UNSUPPORTEDMASK
0x88760219 DDERR_VERTICALBLANKINPROGRESS
0x8876021C DDERR_WASSTILLDRAWING
0x88760230 DDERR_XALIGN
0x88760231 DDERR_INVALIDDIRECTDRAWGUID
0x88760232 DDERR_DIRECTDRAWALREADYCREATED
0x88760233 DDERR_NODIRECTDRAWHW
0x88760234 DDERR_PRIMARYSURFACEALREADYEXISTS
0x88760235 DDERR_NOEMULATION
0x88760236 DDERR_REGIONTOOSMALL
0x88760237 DDERR_CLIPPERISUSINGHWND
0x88760238 DDERR_NOCLIPPERATTACHED
0x88760239 DDERR_NOHWND
0x8876023A DDERR_HWNDSUBCLASSED
0x8876023B DDERR_HWNDALREADYSET
0x8876023C DDERR_NOPALETTEATTACHED
0x8876023D DDERR_NOPALETTEHW
0x8876023E DDERR_BLTFASTCANTCLIP
0x8876023F DDERR_NOBLTHW
0x88760240 DDERR_NODDROPSHW
0x88760241 DDERR_OVERLAYNOTVISIBLE
0x88760242 DDERR_NOOVERLAYDEST
0x88760243 DDERR_INVALIDPOSITION
0x88760244 DDERR_NOTAOVERLAYSURFACE
0x88760245 DDERR_EXCLUSIVEMODEALREADYSET
0x88760246 DDERR_NOTFLIPPABLE
0x88760247 DDERR_CANTDUPLICATE
0x88760248 DDERR_NOTLOCKED
0x88760249 DDERR_CANTCREATEDC
0x8876024A DDERR_NODC
0x8876024B DDERR_WRONGMODE
0x8876024C DDERR_IMPLICITLYCREATED
0x8876024D DDERR_NOTPALETTIZED
0x8876024E DDERR_UNSUPPORTEDMODE
0x8876024F DDERR_NOMIPMAPHW
0x88760250 DDERR_INVALIDSURFACETYPE
0x8876026C DDERR_DCALREADYCREATED
0x88760280 DDERR_CANTPAGELOCK
0x88760294 DDERR_CANTPAGEUNLOCK
0x887602A8 DDERR_NOTPAGELOCKED
"""


def codes() -> list[tuple[int, str]]:
    """All codes with their names; 0 is no error."""
    return [(int(code, 16), name) for code, name in (line.split() for line in CODES.split("\n") if line)]


def with_name(df: DataFrame, code: Column, out: str = "name", default: str = "???") -> DataFrame:
    """``df`` with the name of each code (unsigned), or ``default`` (S9).  The table has about a hundred rows and is broadcast."""
    spark: SparkSession = df.sparkSession
    names = spark.createDataFrame(codes(), "_code bigint, _name string")
    keyed = df.withColumn("_code", code.cast("bigint"))
    return keyed.join(F.broadcast(names), "_code", "left").withColumn(out, F.coalesce("_name", F.lit(default))).drop("_code", "_name")
